"""The property graph: node types and relationship triplets over DataFrames, and their schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.types import spark_type, system_default


class CatalogError(ValueError):
    pass


@dataclass
class NodeType:
    """``df`` has one column per property; ``key`` names the primary key."""

    label: str
    key: str
    df: DataFrame
    ordinal: int = 0
    types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, Column] = field(default_factory=dict)

    @property
    def props(self) -> list[str]:
        return self.df.columns


@dataclass
class RelTriplet:
    """Edges of one type between two labels: ``df`` has _src, _dst (keys of the end nodes), _eid and the properties."""

    type: str
    src: str
    dst: str
    df: DataFrame
    multiplicity: str = "MANY_TO_MANY"
    types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, Column] = field(default_factory=dict)
    sort_key: str | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_src", "_dst", "_eid")]

    def fans_out(self, forward: bool) -> bool:
        """Whether a node can have several of these edges in the direction."""
        left, right = (self.multiplicity.split("_TO_") + ["MANY"])[:2]
        return (right if forward else left) == "MANY"


class PropertyGraph:
    """A catalog of immutable snapshots: each change puts new DataFrames in the place of old ones."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.nodes: dict[str, NodeType] = {}
        self.rels: dict[str, list[RelTriplet]] = {}
        self._ordinals = 0

    # ---- building

    def add_node(self, label: str, key: str, df: DataFrame, types: dict[str, str] | None = None, defaults: dict | None = None) -> PropertyGraph:
        if label in self.nodes or label in self.rels:
            raise CatalogError(f"{label} already exists")
        if key not in df.columns:
            raise CatalogError(f"{label} has no property {key}")
        self._ordinals += 1
        self.nodes[label] = NodeType(label, key, df, self._ordinals, types or {}, defaults or {})
        return self

    def add_rel(self, type_: str, src: str, dst: str, df: DataFrame, src_col: str = "_src", dst_col: str = "_dst", multiplicity: str = "MANY_TO_MANY", types: dict | None = None, defaults: dict | None = None, sort_key: str | None = None) -> PropertyGraph:
        """Without a column _eid, an edge is identified by its values and its number among equal ones. That number takes a
        shuffle of the edges, in queries that read edge ids; give _eid, or a multiplicity that allows no equal edges, to spare it."""
        for label in (src, dst):
            if label not in self.nodes:
                raise CatalogError(f"no node type {label}")
        if type_ in self.nodes:
            raise CatalogError(f"{type_} already exists")
        if any((t.src, t.dst) == (src, dst) for t in self.rels.get(type_, [])):
            raise CatalogError(f"{type_} from {src} to {dst} already exists")
        props = [c for c in df.columns if c not in (src_col, dst_col, "_eid")]
        if "_eid" in df.columns:
            eid = F.col("_eid")
        else:
            values = [F.col(f"`{c}`") for c in df.columns]
            number = F.row_number().over(Window.partitionBy(*values).orderBy(F.lit(0))) if multiplicity == "MANY_TO_MANY" else F.lit(1)
            eid = F.xxhash64(F.lit(f"{type_}:{src}:{dst}"), *values, *[v.isNull() for v in values], number)
        own = df.select(F.col(src_col).alias("_src"), F.col(dst_col).alias("_dst"), eid.alias("_eid"), *props)
        self.rels.setdefault(type_, []).append(RelTriplet(type_, src, dst, own, multiplicity, types or {}, defaults or {}, sort_key))
        return self

    def create_node_table(self, label: str, columns: list[tuple], key: str) -> None:
        if key not in [c[0] for c in columns]:
            raise CatalogError(f"{label} has no property {key}")
        schema = T.StructType([T.StructField(n, spark_type(t)) for n, t, _ in columns])
        defaults = {n: system_default(spark_type(t)) if d is None else d.cast(spark_type(t)) for n, t, d in columns}
        self.add_node(label, key, self.spark.createDataFrame([], schema), {n: t for n, t, _ in columns}, defaults)

    def create_rel_table(self, type_: str, pairs: list[tuple[str, str]], columns: list[tuple], multiplicity: str, sort_key: str | None = None) -> None:
        for src, dst in pairs:
            for label in (src, dst):
                if label not in self.nodes:
                    raise CatalogError(f"no node type {label}")
            fields = [T.StructField("_src", self.key_type(src)), T.StructField("_dst", self.key_type(dst)), T.StructField("_eid", T.LongType())]
            schema = T.StructType(fields + [T.StructField(n, spark_type(t)) for n, t, _ in columns])
            defaults = {n: system_default(spark_type(t)) if d is None else d.cast(spark_type(t)) for n, t, d in columns}
            self.add_rel(type_, src, dst, self.spark.createDataFrame([], schema), multiplicity=multiplicity, types={n: t for n, t, _ in columns}, defaults=defaults, sort_key=sort_key)

    def copy(self) -> PropertyGraph:
        """A graph with the same snapshots, whose changes leave this one alone."""
        g = PropertyGraph(self.spark)
        g.nodes = {k: replace(n, types=dict(n.types), defaults=dict(n.defaults)) for k, n in self.nodes.items()}
        g.rels = {k: [replace(t, types=dict(t.types), defaults=dict(t.defaults)) for t in ts] for k, ts in self.rels.items()}
        g._ordinals = self._ordinals
        return g

    # ---- looking up

    def key_type(self, label: str) -> T.DataType:
        n = self.nodes[label]
        return n.df.schema[n.key].dataType

    def node(self, label: str) -> NodeType:
        if label not in self.nodes:
            raise CatalogError(f"no node type {label}")
        return self.nodes[label]

    def triplets(self, types: tuple[str, ...] | list[str]) -> list[RelTriplet]:
        for t in types:
            if t not in self.rels:
                raise CatalogError(f"no relationship type {t}")
        return [t for name in (types or self.rels) for t in self.rels[name]]

    @property
    def text_ids(self) -> bool:
        """Ids are longs if all primary keys are whole numbers, else texts."""
        return not all(isinstance(self.key_type(n), T.IntegralType) for n in self.nodes)

    def as_id(self, c: Column) -> Column:
        return c.cast("string") if self.text_ids else c.cast("long")

    def internal_id(self, label: Column, id_: Column) -> Column:
        """The label's number in the upper bits, and below them the key, or a hash of a key that is text."""
        ordinal = F.lit(None).cast("long")
        for n in self.nodes.values():
            ordinal = F.when(label == n.label, F.lit(n.ordinal - 1)).otherwise(ordinal)
        low = F.xxhash64(id_).bitwiseAND(F.lit((1 << 56) - 1)) if self.text_ids else id_
        return F.shiftleft(ordinal.cast("long"), 56) + low

    def schema(self) -> dict:
        nodes = [{"label": n.label, "primary_key": n.key, "properties": {f.name: n.types.get(f.name) or f.dataType.simpleString() for f in n.df.schema}} for n in self.nodes.values()]
        rels = [
            {"type": t.type, "from": t.src, "to": t.dst, "multiplicity": t.multiplicity, "properties": {p: t.types.get(p) or t.df.schema[p].dataType.simpleString() for p in t.props}}
            for ts in self.rels.values()
            for t in ts
        ]
        return {"nodes": nodes, "relationships": rels}
