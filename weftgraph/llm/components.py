"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): for each node of ``edges`` (a, b) the least node of its component.

    Alternates the large-star and small-star steps until the edges stay the same. Each step is a partial aggregation,
    written, and a join on the node in which adaptive execution may therefore split the edges of a star's centre. Each
    round is written to the shared folder and the one before it deleted; only a count and a checksum reach the driver.
    No edges: no rows. Loops and repeated edges have no effect.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == seen or not state["n"]:
            break
        seen = tuple(state)
        written = [now]
        for step in (_large_star, _small_star):
            least, now = step(written[-1])
            written += [least, now]
        for old in written[:-1]:
            discard(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's greater neighbours are linked with the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return least, materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's lesser neighbours, and the node itself, are linked with the least of them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    joined = edges.join(least, "u")
    linked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return least, materialize(linked.distinct())
