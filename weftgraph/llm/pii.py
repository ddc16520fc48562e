"""Personal data by fixed patterns and by bootstrapped context patterns.

Fixed patterns find e-mail addresses, IP addresses, card numbers and phone numbers. These entities, and long hexadecimal
strings as keys are written, are the seeds. An instance is a whole identifier-like token, a pattern the words around
it: the word on its left, the two words there, the word on its right, and the left and right words together. Which
instance meets which pattern is a bipartite graph; copies of a text meet once. Spark scores it in turns: a pattern is
as sure as the share of its instances that are held to be personal data, an instance as sure as the surest pattern
that meets it. A token is found, with the kind ``other``, just where a sure pattern stands around it.

Nulls: a null text is empty; a null id stays null, and each row is judged by itself. Very long texts are read whole, in
time that grows with their length. Repeated rows give repeated results, but count once in the graph, so they make no
pattern surer. Ties do not arise: a token is found if any pattern around it reaches the threshold. An empty table gives
no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, with_row_id

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
#: A seed that is no personal data by itself; found only where a sure pattern stands.
SECRET = "secret"
#: A pattern's instances are counted as this many more, none of them personal data.
DOUBT = 2
#: Shares the rows of a hot pattern among tasks.
SALTS = 16
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails from the first digit of a run fails from its others too, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SECRET = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
#: What makes a token identifier-like, up to the white space that ends it.
_CANDIDATE = re.compile(r"[0-9@_]\S*")
_EDGE = ".,;:!?\"'()[]{}<>#*$%&|="
#: Characters of a token that is no identifier: too short to tell anyone from others.
LEAST_CHARS = 4
#: Longer words and tokens stand in the graph by their digests.
WHOLE_CHARS = 64


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the run of local characters before it and the domain after it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_byte(part: str) -> bool:
    rest = part.lstrip("0")
    return len(rest) < 4 and int(rest or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then by start."""
    spans = [("email", s, e) for s, e in find_emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return spans
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_is_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return spans


def _named(word: str) -> str:
    """A word or token as a node: in lower case, without signs at its ends; a very long one by its digest."""
    word = word.strip(_EDGE).lower() or word
    return word if len(word) <= WHOLE_CHARS else blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _word_before(text: str, at: int, low: int) -> tuple[str, int]:
    """The word that ends before ``at`` and begins at ``low`` at the earliest, and its start."""
    while at > low and text[at - 1].isspace():
        at -= 1
    end = at
    while at > low and not text[at - 1].isspace():
        at -= 1
    return text[at:end], at


_WORD = re.compile(r"\S+")


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of identifier-like tokens, without signs at their ends. Each character is visited a bounded number of times."""
    done = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        start = max(start, text.rfind("=", start, end) + 1)  # what is assigned; the name before it is the word on the left
        if end - start >= LEAST_CHARS:
            yield start, end


def patterns_around(text: str, start: int, end: int, low: int, high: int) -> list[str]:
    """The patterns around text[start:end], of the words in text[low:high]. Signs beside the token belong to no word."""
    while start > low and text[start - 1] in _EDGE:
        start -= 1
    while end < high and text[end] in _EDGE:
        end += 1
    near, at = _word_before(text, start, low)
    far, _ = _word_before(text, at, low)
    m = _WORD.search(text, end, high)
    near, far, after = (_named(w) if w else "" for w in (near, far, m[0] if m else ""))
    found = {f"{near} _": near, f"{far} {near} _": far, f"_ {after}": after, f"{near} _ {after}": near and after}
    return sorted(p for p, there in found.items() if there)


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, str, list[str]]]:
    """(kind or null, start, end, instance, patterns) of the fixed matches, and of other identifier-like tokens.

    The words around a place reach to the next place on each side, so that places which follow on one another take
    linear time, and no identifier is another one's context.
    """
    taken = sorted((s, e) for _, s, e in spans)
    found: list[tuple[str | None, int, int]] = list(spans)
    at, reach = 0, 0  # reach: the farthest end of the fixed matches that begin before the token's end
    for start, end in tokens(text):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            found.append((SECRET if _SECRET.fullmatch(text, start, end) else None, start, end))
    starts, ends = sorted(s for _, s, _ in found), sorted(e for _, _, e in found)
    out = []
    for kind, start, end in found:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        low, high = ends[before - 1] if before else 0, starts[after] if after < len(starts) else len(text)
        out.append((kind, start, end, _named(text[start:end]), patterns_around(text, start, end, low, high)))
    return out


_SPAN = "start:int,end:int"
_FOUND = f"array<struct<kind:string,{_SPAN},instance:string,patterns:array<string>>>"


def extract(rows: DataFrame, row_id: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(uid, the long columns ``keep``, spans, found) for each row: its fixed matches, and its candidates with the patterns around them. No text is kept."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    cand = pa.struct([*span, pa.field("instance", pa.string()), pa.field("patterns", pa.list_(pa.string()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            spans, found = [], []
            for t in b[0]:
                text = t.as_py() or ""
                own = base_spans(text)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                found.append([dict(zip(("kind", "start", "end", "instance", "patterns"), c, strict=True)) for c in candidates(text, own)])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(cand))], names=["uid", *keep, "spans", "found"])

    own = "".join(f"{c} long, " for c in keep)
    return rows.select(F.col(text_col).alias("_text"), F.col(row_id).alias("uid"), *keep).mapInArrow(run, f"uid long, {own}spans array<struct<kind:string,{_SPAN}>>, found {_FOUND}")


def bootstrap(found: DataFrame, rounds: int = 3, threshold: float = 0.6) -> DataFrame:
    """Rows (pattern, conf): the patterns that are sure, from rows (kind, instance, patterns); kind is not null for seeds.

    conf is the sum of the beliefs in a pattern's different instances by their number raised by DOUBT; belief is 1 for
    seeds, and for others the greatest conf of the patterns that meet them, if it reaches ``threshold``. No seeds: none.
    """
    edges = found.select("instance", F.col("kind").isNotNull().alias("seed"), F.explode("patterns").alias("pattern"))
    graph = materialize(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))

    def scored(beliefs: DataFrame) -> DataFrame:
        """Written apart from the join that uses it, so that adaptive execution may split a hot pattern there."""
        conf = F.sum("belief") / (F.count(F.lit(1)) + DOUBT)
        return materialize(beliefs.groupBy("pattern").agg(conf.alias("conf")).where(F.col("conf") >= threshold))

    seeds = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(0.0))
    sure = scored(graph.select("pattern", seeds.alias("belief")))
    for _ in range(rounds - 1):
        met = dealt(graph.where("NOT seed"), sure).groupBy("instance").agg(F.max("conf").alias("known"))
        beliefs = graph.join(materialize(met), "instance", "left").select("pattern", F.greatest(seeds, F.coalesce("known", F.lit(0.0))).alias("belief"))
        sure = scored(beliefs)
    return sure


def dealt(rows: DataFrame, sure: DataFrame) -> DataFrame:
    """``rows`` joined with the sure patterns, which are few beside them and are repeated for each salt, so that the rows of a hot pattern meet in SALTS tasks."""
    salt = F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(sure.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pattern", "_salt"]).drop("_salt")


def added_spans(extracted: DataFrame, **bootstrapping) -> DataFrame:
    """(uid, more) for the rows in which sure patterns stand around tokens that are no fixed matches; more is sorted by start."""
    one = extracted.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    sure = bootstrap(one, **bootstrapping)
    places = one.where(F.col("kind").isNull() | (F.col("kind") == SECRET)).select("uid", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    return dealt(places, sure).groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("more"))


def _found(extracted: DataFrame, **bootstrapping) -> DataFrame:
    """``extracted`` with ``more`` for ``found``."""
    added = materialize(added_spans(extracted, **bootstrapping))
    return extracted.drop("found").join(added, "uid", "left").withColumn("more", F.coalesce("more", F.array().cast(f"array<struct<{_SPAN}>>")))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrapping) -> DataFrame:
    """Rows (doc_id, spans, more): fixed matches, and the spans of kind ``other`` that bootstrapping adds.

    Every row of ``df`` gives a row; null texts are empty and have no spans. Spans are in code points, ends exclusive;
    added spans never overlap fixed ones. ``more`` is sorted by start.
    """
    one = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _found(materialize(extract(one, "uid", keep=("doc_id",))), **bootstrapping).drop("uid")


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are merged under the first kind."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_pii(df: DataFrame, text_col: str = "text", **bootstrapping) -> DataFrame:
    """``df`` with the personal data in its text masked, and all other columns as they are.

    The rows are written once with a number each; the spans found meet them by it, so no key is hot.
    """
    uid, own, more = (fresh(df, name) for name in ("_uid", "_own", "_more"))
    rows = with_row_id(df, uid)

    @F.pandas_udf("string")
    def masked(texts: pd.Series, fixed: pd.Series, added: pd.Series) -> pd.Series:
        def one(text, fixed, added):
            return mask(text, [(s["kind"], s["start"], s["end"]) for s in fixed] + [(OTHER, s["start"], s["end"]) for s in added])

        return pd.Series([one(*x) for x in zip(texts, fixed, added, strict=True)], dtype=object)

    spans = _found(materialize(extract(rows, uid, text_col)), **bootstrapping).select(F.col("uid").alias(uid), F.col("spans").alias(own), F.col("more").alias(more))
    return rows.join(spans, uid).withColumn(text_col, masked(F.col(text_col), F.col(own), F.col(more))).select(*df.columns)
