"""Scans and expansions as joins on keys.

An edge table is a union over the matching triplets, narrowed to the wanted columns before the join. The end node's
table is joined only if its properties are used: the triplets already tell its label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import PropertyGraph, RelTriplet


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def node_table(graph: PropertyGraph, labels: tuple[str, ...], c: str, props: tuple[str, ...]) -> DataFrame:
    """{c}__id, {c}__label and the properties of all nodes with one of the labels; a property a label lacks is null."""
    parts = []
    for label in labels:
        n = graph.node(label)
        own = [F.col(p).alias(f"{c}__p_{p}") for p in props if p in n.props]
        parts.append(n.df.select(graph.as_id(F.col(n.key)).alias(f"{c}__id"), F.lit(label).alias(f"{c}__label"), *own))
    out = union(parts)
    return out.select(f"{c}__id", f"{c}__label", *(f"{c}__p_{p}" for p in props if f"{c}__p_{p}" in out.columns))


def oriented(triplets: list[RelTriplet], left: tuple[str, ...], right: tuple[str, ...], direction: str) -> list[tuple[RelTriplet, bool]]:
    """(triplet, forward) for the edges that lead from a left label to a right label in the direction."""
    out = []
    for t in triplets:
        if direction in ("out", "both") and t.src in left and t.dst in right:
            out.append((t, True))
        if direction in ("in", "both") and t.dst in left and t.src in right:
            out.append((t, False))
    return out


def edge_table(graph: PropertyGraph, chosen: list[tuple[RelTriplet, bool]], c: str, props: tuple[str, ...], whole: bool) -> DataFrame:
    """{c}__f and {c}__t (keys from and to), their labels {c}__fl and {c}__tl, and for ``whole`` edges all of RelB's columns."""
    parts = []
    for t, forward in chosen:
        src, dst = graph.as_id(F.col("_src")), graph.as_id(F.col("_dst"))
        f, to, fl, tl = (src, dst, t.src, t.dst) if forward else (dst, src, t.dst, t.src)
        columns = [f.alias(f"{c}__f"), to.alias(f"{c}__t"), F.lit(fl).alias(f"{c}__fl"), F.lit(tl).alias(f"{c}__tl")]
        if whole:
            columns += [src.alias(f"{c}__src"), F.lit(t.src).alias(f"{c}__slabel"), dst.alias(f"{c}__dst"), F.lit(t.dst).alias(f"{c}__dlabel"), F.lit(t.type).alias(f"{c}__type"), F.col("_eid").alias(f"{c}__eid")]
        columns += [F.col(p).alias(f"{c}__p_{p}") for p in props if p in t.props]
        parts.append(t.df.select(*columns))
    return union(parts)


def known_props(graph: PropertyGraph, labels: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for label in labels for p in graph.node(label).props))


def known_rel_props(triplets: list[RelTriplet]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for t in triplets for p in t.props))
