"""Incremental loading: a stream's micro-batches become new snapshots of a node or relationship table.

A batch can be replayed after a failure. Nodes whose key exists are left out, and an edge's id is made of the
stream's name, the batch number and its values, so a replayed batch adds nothing. Every COMPACT_EVERY batches the
table is written as one, so its plan does not grow with the number of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dml import append_nodes
from ..operators.paths import written
from ..session import GraphDatabase

#: Batches after which a table's parts are written as one.
COMPACT_EVERY = 20


def load_nodes(db: GraphDatabase, label: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the rows of ``stream`` (columns named as properties) to ``label``; of rows with one key the first in order of values stays."""
    key = db.graph.node(label).key

    def batch(df: DataFrame, number: int) -> None:
        n = db.graph.node(label)
        rest = [c for c in df.columns if c != key]
        one = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*") if rest else df.distinct()
        append_nodes(db.graph, label, one.join(n.df.select(key), key, "left_anti"))
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            n.df = written(n.df)

    return _start(stream, batch, checkpoint, available_now)


def load_rels(db: GraphDatabase, type_: str, src: str, dst: str, stream: DataFrame, checkpoint: str, name: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Appends the rows of ``stream`` (_src, _dst and properties) to a triplet; edges without both end nodes are refused by an error."""

    def batch(df: DataFrame, number: int) -> None:
        t = next(t for t in db.graph.rels[type_] if (t.src, t.dst) == (src, dst))
        new = df.select(F.col("_src").cast(t.df.schema["_src"].dataType), F.col("_dst").cast(t.df.schema["_dst"].dataType), F.xxhash64(F.lit(name), F.lit(number), *df.columns).alias("_eid"), *[F.col(p).cast(t.df.schema[p].dataType) for p in t.props])
        new = written(new.join(t.df.select("_eid"), "_eid", "left_anti").select("_src", "_dst", "_eid", *t.props))
        for side, label in (("_src", src), ("_dst", dst)):
            n = db.graph.node(label)
            if not new.join(n.df.select(F.col(n.key).alias(side)), side, "left_anti").isEmpty():
                raise ValueError(f"{type_}: an end node is missing in {label}")
        t.df = t.df.unionByName(new)
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            t.df = written(t.df)

    return _start(stream, batch, checkpoint, available_now)


def _start(stream: DataFrame, batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
