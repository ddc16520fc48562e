"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled texts: words whose presence in toxic texts is far beyond chance. It is held as a
trie; the Levenshtein automaton of a word is run along the trie's paths, so a misspelled term is met with one walk
for all terms. Words that clean labelled texts use are never read as misspellings. Around each hit a window of words
tells quotation from abuse: for each word the labelled texts say how much oftener it stands in the windows of hits of
toxic texts than in those of clean ones, and a window's score is the sum of these log ratios. Hits between quotation
marks or in a window that speaks of clean use count as quoted, those in a window that speaks of abuse count more. A
logistic model of the summed evidence gives the score.

Nulls: a null text is empty, and scores like one without hits; null labels and ids teach nothing. Very long texts are
read whole. Repeated texts are learned once, toxic if any copy is; repeated rows get equal scores. Ties among terms go
to the lesser word. Without labelled texts there are no terms and all score low; an empty table gives no rows. Further
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches

_TOKEN = re.compile(r"[^\W_]+")
_QUOTES = re.compile(r"[\"“”«»„]")
WINDOW = 4
#: A window whose score is this far below zero speaks of quotation, this far above of abuse.
CLEAR = 1.0


def _trie(terms) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
    return root


def _intersect(node: dict, state: tuple, word: str, most: int, found: set) -> None:
    """Terms below ``node`` that the Levenshtein automaton of ``word``, in ``state``, accepts within ``most`` edits.

    A state holds, for each prefix of the word, the edits between it and the path so far; paths on which all are
    beyond ``most`` are left.
    """
    stack = [(node, state)]
    while stack:
        node, state = stack.pop()
        for c, child in node.items():
            if c == "":
                if state[-1] <= most:
                    found.add(child)
                continue
            after = _step(state, c, word)
            if min(after) <= most:
                stack.append((child, after))


def _step(state: tuple, c: str, word: str) -> tuple:
    after = [state[0] + 1]
    for i, w in enumerate(word):
        after.append(min(after[i] + 1, state[i + 1] + 1, state[i] + (w != c)))
    return tuple(after)


class Trie:
    """Lexicon terms with weights, as a trie and as a trie of the reversed terms.

    One edit leaves the first or the last half of a term untouched. So the automaton is entered only below the word's
    own first half in the trie, and below its reversed last half in the reversed trie; a word with neither is no hit.
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.root, self.reversed = _trie(weights), _trie(t[::-1] for t in weights)
        self.heads = {(len(t), t[: (len(t) + 1) // 2]) for t in weights}
        self.tails = {(len(t), t[(len(t) + 1) // 2 :]) for t in weights}
        self.lengths = sorted({len(t) for t in weights})

    def _entries(self, word: str) -> tuple[set[str], set[str]]:
        heads, tails = set(), set()
        for size in range(max(1, len(word) - 1), len(word) + 2):
            half = (size + 1) // 2
            if (size, word[:half]) in self.heads:
                heads.add(word[:half])
            tail = word[len(word) - (size - half) :]
            if (size, tail) in self.tails:
                tails.add(tail)
        return heads, tails

    def near(self, word: str) -> bool:
        return any(self._entries(word))

    def within(self, word: str) -> list[str]:
        """The terms within one insertion, deletion or substitution of ``word``."""
        heads, tails = self._entries(word)
        found: set[str] = set()
        for root, text, entries, turn in ((self.root, word, heads, 1), (self.reversed, word[::-1], {t[::-1] for t in tails}, -1)):
            hits: set[str] = set()
            for entry in entries:
                node, state = root, tuple(range(len(text) + 1))
                for c in entry:
                    node, state = node[c], _step(state, c, text)
                _intersect(node, state, text, 1, hits)
            found |= {t[::turn] for t in hits}
        return sorted(found)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    clean: frozenset[str] = frozenset()
    coefficients: list[float] = field(default_factory=lambda: [-4.0, 6.0, 3.0, 0.5, -3.0, 1.0])
    least_fuzzy: int = 5
    context: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.trie = Trie(self.weights)
        self.known: dict[str, tuple[float, bool] | None] = {}

    def __getstate__(self):
        return self.weights, self.clean, self.coefficients, self.least_fuzzy, self.context

    def __setstate__(self, state):
        self.weights, self.clean, self.coefficients, self.least_fuzzy, self.context = state
        self.__post_init__()

    def _look_up(self, word: str) -> tuple[float, bool] | None:
        got = None
        if word in self.weights:
            got = self.weights[word], False
        elif len(word) >= self.least_fuzzy and word not in self.clean and self.trie.near(word):
            terms = [t for t in self.trie.within(word) if len(t) >= self.least_fuzzy]
            if terms:
                got = max(self.weights[t] for t in terms), True
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = got
        return got

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, tuple[float, bool]]]]:
        """The text's words, and (place, (weight, misspelled)) of those that are terms."""
        words = _TOKEN.findall(text.lower())
        known, look_up = self.known, self._look_up
        return words, [(i, h) for i, w in enumerate(words) if (h := known[w] if w in known else look_up(w)) is not None]

    def features(self, text: str | None) -> list[float]:
        """1, best exact term, best misspelled term, count of hits, best quoted term, best term in a window of abuse."""
        text = text or ""
        words, hits = self.hits(text)
        if not hits:
            return [1.0, 0, 0, 0, 0, 0]
        quoted = _quoted(text, {words[i] for i, _ in hits}) if _QUOTES.search(text) else frozenset()
        best = [0.0] * 4
        for i, (weight, fuzzy) in hits:
            score = sum(self.context.get(w, 0.0) for w in window(words, i)) if self.context else 0.0
            kind = 2 if words[i] in quoted or score <= -CLEAR else 1 if fuzzy else 0
            best[kind] = max(best[kind], weight)
            if kind < 2 and score >= CLEAR:
                best[3] = max(best[3], weight)
        return [1.0, best[0], best[1], math.log1p(len(hits)), best[2], best[3]]

    def score(self, text: str | None) -> float:
        z = sum(c * x for c, x in zip(self.coefficients, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def window(words: list[str], i: int) -> set[str]:
    """The words within WINDOW of the i-th."""
    return {*words[max(0, i - WINDOW) : i], *words[i + 1 : i + 1 + WINDOW]}


def _quoted(text: str, terms: set[str]) -> frozenset[str]:
    """The terms all of whose occurrences stand between quotation marks."""
    inside = [w for part in _QUOTES.split(text.lower())[1::2] for w in _TOKEN.findall(part)]
    outside = {w for part in _QUOTES.split(text.lower())[::2] for w in _TOKEN.findall(part)}
    return frozenset(t for t in terms if t in inside and t not in outside)


def labelled_sample(df: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str, lang_col: str | None) -> DataFrame:
    """(text, y): at most ``fit_rows`` texts of each label, those with the least hashes of id; ids are broadcast, bounded by fit_rows."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("y"))
    picked = [one.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(chosen, "_id")
    return rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def _word_lists(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, y, texts with it): summed over the task's rows first."""
    counts: dict[tuple[str, int], int] = {}
    for b in parts:
        for text, y in zip(b[0], b[1].to_pylist(), strict=True):
            for w in set(_TOKEN.findall(text.as_py().lower())):
                counts[w, y] = counts.get((w, y), 0) + 1
    schema = pa.schema([("word", pa.string()), ("y", pa.int32()), ("n", pa.int64())])
    yield from batches(((w, y, n) for (w, y), n in counts.items()), schema, most_rows=50_000)


def fit_toxicity(df: DataFrame, labels: DataFrame, fit_rows: int = 8000, most_terms: int = 4000, least_texts: int = 3, least_gain: float = 15.0, most_context: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on at most ``fit_rows`` different texts of each label; keep held-out rows out of ``labels``.

    The lexicon has at most ``most_terms`` words, and as many as ``most_context`` words have a say in windows. With no toxic texts the model has no terms and scores low.
    """
    from .common import materialize

    sample = materialize(labelled_sample(df, labels, fit_rows, id_col, text_col, label_col, None))
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1:
        return ToxicityModel({})
    counts = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(_word_lists, "word string, y int, n long")
    by_word = materialize(
        counts.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    )
    odds = F.log((F.col("t") + 0.1) / (n1 + 0.2)) - F.log((F.col("c") + 0.1) / (n0 + 0.2))
    # gain: expected toxic texts of a word under independence, against those seen (log-likelihood ratio)
    share = n1 / max(1, n1 + n0)
    gain = 2 * (F.col("t") * F.log(F.greatest(F.col("t"), F.lit(0.5)) / ((F.col("t") + F.col("c")) * share)) + F.col("c") * F.log(F.greatest(F.col("c"), F.lit(0.5)) / ((F.col("t") + F.col("c")) * (1 - share))))
    terms = by_word.where((F.col("t") >= least_texts) & (odds > 3.0)).withColumn("odds", odds).withColumn("gain", gain).where(F.col("gain") > least_gain).orderBy(F.desc("gain"), "word").limit(most_terms)
    found = terms.collect()  # at most most_terms
    top = max((r["odds"] for r in found), default=1.0)
    weights = {r["word"]: round(min(1.0, r["gain"] / 60) * r["odds"] / top, 4) for r in found}
    model = ToxicityModel(weights)
    trie = model.trie

    def clean_neighbours(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            words = [w for w in b[0].to_pylist() if w not in weights and trie.near(w) and trie.within(w)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    veto = by_word.where("c > 0").select("word").mapInArrow(clean_neighbours, "word string")
    model.clean = frozenset(r["word"] for r in veto.collect())  # neighbours of the terms among the sample's words

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, y, texts in which it stands near a hit); the word null: texts with hits."""
        seen: dict[tuple[str | None, int], int] = {}
        for b in parts:
            for text, y in zip(b[0], b[1].to_pylist(), strict=True):
                words, hits = model.hits(text.as_py())
                for w in set().union(*[window(words, i) for i, _ in hits]) - weights.keys() | ({None} if hits else set()):
                    seen[w, y] = seen.get((w, y), 0) + 1
        schema = pa.schema([("word", pa.string()), ("y", pa.int32()), ("n", pa.int64())])
        yield from batches(((w, y, n) for (w, y), n in seen.items()), schema, most_rows=50_000)

    near = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(windows, "word string, y int, n long")
    near = materialize(near.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c")))
    if totals_ := near.where("word IS NULL").first():
        h1, h0 = totals_["t"], totals_["c"]
        ratio = F.log((F.col("t") + 0.5) / (h1 + 1)) - F.log((F.col("c") + 0.5) / (h0 + 1))
        # a word's ratio counts as far as chance would not explain it: less twice its standard error
        sure = F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
        told = near.where("word IS NOT NULL").select("word", sure.alias("s")).where("s <> 0").orderBy(F.desc(F.abs("s")), "word").limit(most_context)
        model.context = {r["word"]: round(r["s"], 4) for r in told.collect()}  # at most most_context

    def vectors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = [model.features(t.as_py()) for t in b[0]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b[1]], names=["x", "y"])

    rows = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(vectors, "x array<double>, y int")
    grouped = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * fit_rows short vectors
    x, y, n = np.array([r["x"] for r in grouped]), np.array([r["y"] for r in grouped], float), np.array([r["n"] for r in grouped], float)
    model.coefficients = _logistic(x, y, n)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.05) -> list[float]:
    """Ridge logistic regression towards a prior in which quotation weakens and address strengthens the evidence."""
    prior = np.array([-3.0, 8.0, 4.0, 1.0, 0.5, 2.0])
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - penalty * (beta - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(beta)), grad)
        beta += step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score) for every row; null and empty texts get the score of a text without hits.

    The model is bounded by the fit (terms, vetoed neighbours) and is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in parts:
            yield pa.RecordBatch.from_arrays([b[0], pa.array([score(t.as_py()) for t in b[1]], pa.float64())], names=["doc_id", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
