"""Language identification by compression.

For each language a raw-content dictionary is made of labelled texts. A text is cut into blocks, each block is
compressed by zstandard with each language's dictionary, and the language with the smallest total is chosen. Blocks
keep every part of a long text near the dictionary. The relative margin to the second-best total is the certainty;
below ``least_margin`` the choice is rejected.

Nulls: a null text, like one without a letter, is ``und``; rows with a null label or text teach nothing. Very long texts are
compressed whole, block by block. Ties go to the label with more learned rows, then to the lesser one. Repeated texts
are learned once and get the same result each time. Without rows there are no dictionaries, and without dictionaries
all is ``und``. Columns of ``df`` are kept, but the four that are added replace any of the same names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, worker_state

UNKNOWN = "und"


_LETTERS = re.compile(r"[^\W\d_]+")


def _clean(text: str) -> str:
    """The lower-case words; digits, signs and line ends tell no language."""
    words = _LETTERS.findall(text.lower())
    if not all(map(str.isalpha, words)):  # the pattern also takes numbers that are no decimal digits, such as ² and Ⅷ
        words = "".join(c if c.isalpha() else " " for w in words for c in (*w, " ")).split()
    return " ".join(words)


def fit_dictionaries(df: DataFrame, dictionary_bytes: int = 98_304, text_bytes: int = 4096, lang_col: str = "lang", text_col: str = "text", total_bytes: int = 48 << 20) -> dict[str, bytes]:
    """A raw-content dictionary per language from rows with a text of at most ``text_bytes`` and a label.

    The fit is on a bounded sample: of each language the texts with the least hashes, each text once, up to
    ``dictionary_bytes`` (longer texts are used only if a language has no others, and are then cut).
    Each task keeps only as many texts as can matter, so at most dictionary_bytes a language and task are shuffled.
    Null labels and null or empty texts are left out; no rows: no dictionaries. Labels come in order of their number of
    rows. All dictionaries together stay within ``total_bytes``: where labels are so many that full ones would not, each is
    smaller, and no label goes.
    """
    schema = pa.schema([("lang", pa.string()), ("rank", pa.int64()), ("body", pa.string())])

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, str]] = {}
        order: dict[str, list] = {}
        sizes: dict[str, int] = {}
        for b in parts:
            for lang, text in zip(b[0].to_pylist(), b[1], strict=True):
                body = _clean(text.as_py())
                rank = xxhash.xxh64_intdigest(body, 9) >> 1
                if len(body) > text_bytes:
                    body, rank = body[:text_bytes], rank | 1 << 62
                else:
                    rank &= (1 << 62) - 1
                mine, heap = held.setdefault(lang, {}), order.setdefault(lang, [])
                if rank in mine or sizes.get(lang, 0) >= dictionary_bytes and rank > -heap[0]:
                    continue
                mine[rank] = body
                heapq.heappush(heap, -rank)
                sizes[lang] = sizes.get(lang, 0) + len(body)
                while sizes[lang] - len(mine[-heap[0]]) >= dictionary_bytes:
                    sizes[lang] -= len(mine.pop(-heapq.heappop(heap)))
        rows = [(lang, rank, body) for lang, mine in held.items() for rank, body in mine.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    labelled = df.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    seen = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    dictionary_bytes = max(1, min(dictionary_bytes, total_bytes // max(1, len(seen))))
    text_bytes = min(text_bytes, dictionary_bytes)
    best = labelled.mapInArrow(nearest, "lang string, rank long, body string").dropDuplicates(["lang", "rank"])
    before = Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("before", F.coalesce(F.sum(F.length("body")).over(before), F.lit(0))).where(F.col("before") < dictionary_bytes)
    out: dict[str, list[tuple[int, str]]] = {}
    for r in best.select("lang", "rank", "body").collect():  # at most dictionary_bytes and one text a language
        out.setdefault(r["lang"], []).append((r["rank"], r["body"]))
    in_order = sorted(out.items(), key=lambda x: (-seen[x[0]], x[0]))
    return {lang: "\n".join(body for _, body in sorted(rows, reverse=True)).encode() for lang, rows in in_order}


class CompressionClassifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, block: int = 8192, short: int = 512, short_level: int = 9):
        import zstandard

        self.block, self.short = block, short
        self.compressors, self.closer = {}, {}
        options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        for lang, data in dictionaries.items():
            for at, into in ((level, self.compressors), (short_level, self.closer)):
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=at)
                into[lang] = zstandard.ZstdCompressor(level=at, dict_data=d, **options)

    def sizes(self, text: str) -> dict[str, int]:
        """Compressed bytes of a cleaned text by language."""
        data = text.encode()
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        compressors = self.compressors if len(data) > self.short else self.closer  # short texts need a wider search
        return {lang: sum([len(c.compress(b)) for b in blocks]) for lang, c in compressors.items()}

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score 0 to 1, margin. Null or no letter: ``und``, 0, 0. Ties: the label with more learned rows."""
        text = _clean(text or "")
        if not text or not self.compressors:
            return UNKNOWN, 0.0, 0.0
        ranked = sorted(((n, lang) for lang, n in self.sizes(text).items()), key=lambda x: x[0])
        if len(ranked) == 1:
            return ranked[0][1], 1.0, 1.0
        margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], 1 - math.exp(-25 * margin) / 2, margin


def identify_languages(df: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.003, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """``df`` with lang_pred, lang_score, lang_margin, lang_rejected, or with another ``prefix`` in the place of lang_.

    Rejected: texts that are null or have no letter (``und``), and those with a margin under ``least_margin``.
    The dictionaries are bounded in number and size by the fit and are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)
    key = xxhash.xxh64_hexdigest(b"".join(k.encode() + v for k, v in dictionaries.items()))

    @F.pandas_udf("struct<lang_pred string, lang_score double, lang_margin double>")
    def classify(texts: pd.Series) -> pd.DataFrame:
        classifier = worker_state(("langid", key), lambda: CompressionClassifier(shared.value))
        return pd.DataFrame([classifier.classify(t) for t in texts], columns=["lang_pred", "lang_score", "lang_margin"])

    names = [prefix + x for x in ("pred", "score", "margin", "rejected")]
    at, own = fresh(df, "_lang"), [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names}]
    found = [F.col(f"{at}.lang_{x}").alias(n) for x, n in zip(("pred", "score", "margin"), names, strict=False)]
    out = df.withColumn(at, classify(F.col(text_col))).select(*own, *found)
    return out.withColumn(names[3], (F.col(names[0]) == UNKNOWN) | (F.col(names[2]) < least_margin))
