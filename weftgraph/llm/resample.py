"""Quality by importance resampling: ratio of hashed n-gram models, sampled by Gumbel top-k.

Two bags of hashed word 1- and 2-grams are counted, one over the target texts and one over all raw texts. A text's
log importance is the sum over its n-grams of the log ratio of their smoothed shares. With Gumbel noise added, taking
the k largest is sampling k texts without replacement in proportion to their importance. The noise comes from a hash
of the id and a seed, so a lost task computes the same again. The k-th largest key is found by narrowing an interval
on counts of its parts, so no task and no driver sorts or gathers the keys.

Nulls: a null text weighs like one without n-grams, a null id draws the noise of one fixed id. Very long texts are read
whole. Repeated rows weigh alike and draw the same noise; rows that tie at the k-th key are taken by the hash of their
id, and rows equal in both share one fate. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, splitmix

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Parts that an interval of keys is counted in at a time.
PARTS = 1 << 15


class HashedGrams:
    """Bucket numbers of a text's lower-case 1- and 2-grams."""

    def __init__(self, buckets: int, cached: int = 500_000):
        self.buckets, self.cached, self.known = buckets, cached, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _TOKEN.findall((text or "").lower())
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        if len(known) > self.cached:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = splitmix(h[:-1] * np.uint64(3) + (h[1:] ^ np.uint64(0x5851F42D4C957F2D)))
        return (np.concatenate((h, pairs)) % np.uint64(self.buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, target = HashedGrams(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in parts:
            for text, wanted in zip(b[0], b[1].to_pylist(), strict=True):
                c = np.bincount(grams(text.as_py()), minlength=buckets)
                raw += c
                if wanted:
                    target += c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    return run


def fit_log_ratios(df: DataFrame, buckets: int = 20_000, text_col: str = "text", target_col: str = "_target") -> np.ndarray:
    """log(target share / raw share) by bucket, each count raised by one. Every row counts as raw text."""
    counts = df.select(F.col(text_col).alias("text"), F.coalesce(F.col(target_col), F.lit(False)).alias("target")).mapInArrow(_counts(buckets), "bucket long, raw long, target long")
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # `buckets` rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def importance(df: DataFrame, log_ratios: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, log_weight, mean_log_weight, key) for all rows; texts without n-grams (null, empty) weigh as -infinity's stand-in -1e9."""
    shared = df.sparkSession.sparkContext.broadcast(log_ratios)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        grams = HashedGrams(len(ratios))
        for b in parts:
            total, mean = [], []
            for t in b[1]:
                g = grams(t.as_py())
                total.append(float(ratios[g].sum()) if len(g) else -1e9)
                mean.append(total[-1] / max(1, len(g)))
            ids = np.array([-1 if i is None else i for i in b[0].to_pylist()], np.int64).view(np.uint64)
            u = (splitmix(ids ^ np.uint64(seed * 0x9E3779B9)) >> np.uint64(11)).astype(float) + 0.5
            key = np.array(total) - np.log(-np.log(u * 2.0**-53))
            yield pa.RecordBatch.from_arrays([b[0], pa.array(total), pa.array(mean), pa.array(key)], names=["doc_id", "log_weight", "mean_log_weight", "key"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, log_weight double, mean_log_weight double, key double")


def gumbel_top_k(keyed: DataFrame, k: int) -> DataFrame:
    """Adds ``selected``: whether ``key``, a finite double, is among the k largest; ties go to the smaller doc_id's hash, and rows equal in both share one fate.

    ``keyed`` is read several times: give it materialized. k of at least the row count selects all rows.
    """
    if k <= 0:
        return keyed.withColumn("selected", F.lit(False))
    low, high, left = *keyed.agg(F.min("key"), F.max("key")).first(), k
    within = keyed
    while low is not None and low < high:
        # monotone in the key whatever is rounded, and the ends of the interval are in different parts, so it narrows
        width = high / 2 - low / 2
        part = F.least(F.floor((F.col("key") / 2 - low / 2) / width * PARTS), F.lit(PARTS)).cast("int") if width else (F.col("key") > low).cast("int")
        rows = within.groupBy(part.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()  # at most PARTS + 1
        for r in sorted(rows, key=lambda r: -r["d"]):
            if r["n"] >= left:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
        else:
            return keyed.withColumn("selected", F.lit(True))  # fewer than k rows
        within = keyed.where(F.col("key").between(low, high))
    if low is None or within.count() <= left:
        return keyed.withColumn("selected", F.lit(True) if low is None else F.col("key") >= low)
    # `left` of the rows whose key is the very k-th largest, by id
    order = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("i"))
    last = within.select(order.alias("o")).orderBy("o").limit(left).agg(F.max("o").alias("m")).first()["m"]
    tie = order <= F.struct(*[F.lit(last[c]).alias(c) for c in ("h", "none", "i")])
    return keyed.withColumn("selected", (F.col("key") > low) | ((F.col("key") == low) & tie))


def resample(df: DataFrame, k: int | None = None, share: float = 0.5, buckets: int = 20_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "_target") -> DataFrame:
    """Rows (doc_id, log_weight, mean_log_weight, key, selected); k defaults to ``share`` of the rows.

    ``target_col`` marks the target texts (null: not one). Without targets or rows all weights are of the smoothing
    alone. Repeated rows have the same key.
    """
    keyed = materialize(importance(df, fit_log_ratios(df, buckets, text_col, target_col), seed, id_col, text_col))
    return gumbel_top_k(keyed, round(share * keyed.count()) if k is None else k)
