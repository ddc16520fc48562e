"""Schema statements, checkpoints and extensions over the catalog's snapshots."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import CatalogError, NodeType, PropertyGraph, RelTriplet
from ..functions.types import spark_type, system_default
from ..plans import ast as A
from .scope import Scope

EXTENSIONS = {"json": "JSON arrays and lines", "parquet": "Parquet files", "csv": "CSV files"}


def _default(low, e: Any, type_: str):
    return None if e is None else low.ex(e, Scope(None)).cast(spark_type(type_))


def run(s: Any, low) -> None:
    g: PropertyGraph = low.graph
    if isinstance(s, A.CreateNodeTable):
        if s.name in g.nodes and s.if_not_exists:
            return
        g.create_node_table(s.name, [(n, t, _default(low, d, t)) for n, t, d in s.columns], s.key)
    elif isinstance(s, A.CreateRelTable):
        if s.name in g.rels and s.if_not_exists:
            return
        if s.name in g.rels:
            raise CatalogError(f"{s.name} already exists")
        g.create_rel_table(s.name, s.pairs, [(n, t, _default(low, d, t)) for n, t, d in s.columns], s.multiplicity, s.options.get("sort_key_for_nbr"))
    elif isinstance(s, A.DropTable):
        drop(g, s.name, s.if_exists)
    elif isinstance(s, A.AlterTable):
        alter(g, s, low)


def drop(g: PropertyGraph, name: str, if_exists: bool = False) -> None:
    """A node type goes with the relationship triplets that touch it."""
    if name in g.nodes:
        del g.nodes[name]
        g.rels = {t: kept for t, ts in g.rels.items() if (kept := [x for x in ts if name not in (x.src, x.dst)])}
    elif name in g.rels:
        del g.rels[name]
    elif not if_exists:
        raise CatalogError(f"no table {name}")


def alter(g: PropertyGraph, s: A.AlterTable, low) -> None:
    if s.name not in g.nodes and s.name not in g.rels:
        raise CatalogError(f"no table {s.name}")
    tables = [g.nodes[s.name]] if s.name in g.nodes else g.rels[s.name]
    a = s.args
    if s.action == "rename_table":
        if a["to"] in g.nodes or a["to"] in g.rels:
            raise CatalogError(f"{a['to']} already exists")
        if s.name in g.nodes:
            n = g.nodes.pop(s.name)
            n.label = a["to"]
            g.nodes[a["to"]] = n
            for t in (t for ts in g.rels.values() for t in ts):
                t.src, t.dst = (a["to"] if x == s.name else x for x in (t.src, t.dst))
        else:
            g.rels[a["to"]] = g.rels.pop(s.name)
            for t in g.rels[a["to"]]:
                t.type = a["to"]
        return
    for t in tables:
        name = a["name"]
        has = name in t.props
        if s.action == "add":
            if has and a["if_not_exists"]:
                continue
            if has:
                raise CatalogError(f"{s.name} already has {name}")
            kind = spark_type(a["type"])
            value = system_default(kind) if a["default"] is None else low.ex(a["default"], Scope(None)).cast(kind)
            t.df = t.df.withColumn(name, value)
            t.types[name], t.defaults[name] = a["type"], value
            continue
        if not has:
            if a.get("if_exists"):
                continue
            raise CatalogError(f"{s.name} has no {name}")
        if isinstance(t, NodeType) and t.key == name:
            if s.action == "drop":
                raise CatalogError("the primary key cannot be dropped")
            t.key = a["to"]
        if s.action == "drop":
            t.df = t.df.drop(name)
        else:
            if a["to"] in t.props:
                raise CatalogError(f"{s.name} already has {a['to']}")
            t.df = t.df.withColumnRenamed(name, a["to"])
        for d in (t.types, t.defaults):
            if name in d and s.action == "drop":
                del d[name]
            elif name in d:
                d[a["to"]] = d.pop(name)


def admin(s: A.Admin, db) -> None:
    if s.action == "checkpoint":
        if not db.path:
            raise CatalogError("CHECKPOINT needs a database with a path")
        save(db.graph, db.path)
    elif s.action in ("install", "load"):
        if s.args[0].lower() not in EXTENSIONS:
            raise CatalogError(f"no extension {s.args[0]}")


def loaded_extensions(graph: PropertyGraph) -> DataFrame:
    return graph.spark.createDataFrame(sorted(EXTENSIONS.items()), "name string, description string")


def show_tables(graph: PropertyGraph) -> DataFrame:
    rows = [(n, "NODE") for n in graph.nodes] + [(r, "REL") for r in graph.rels]
    return graph.spark.createDataFrame(rows, "name string, type string")


def _values(spark: SparkSession, defaults: dict) -> dict[str, str]:
    """Declared defaults as JSON texts of their values."""
    if not defaults:
        return {}
    row = spark.range(1).select(*[F.to_json(F.struct(d.alias("v"))).alias(p) for p, d in defaults.items()]).first()
    return row.asDict()


def _defaults(schema: T.StructType, types: dict, values: dict) -> dict:
    out = {p: system_default(spark_type(t)) for p, t in types.items()}
    return out | {p: F.from_json(F.lit(v), T.StructType([T.StructField("v", schema[p].dataType)]))["v"] for p, v in values.items() if p in schema.names}


def save(g: PropertyGraph, path: str) -> None:
    """Each table as Parquet in a new version's folder, and then that version's manifest, which names them.

    Nothing is overwritten, and a manifest counts only once Spark has committed it, so a lost job leaves the old graph.
    """
    version = max(_versions(g.spark, path), default=0) + 1
    tables: dict = {"version": version, "nodes": [], "rels": []}
    for n in g.nodes.values():
        at = f"{path}/v{version}/node-{n.label}"
        n.df.write.mode("overwrite").parquet(at)
        n.df = g.spark.read.schema(n.df.schema).parquet(at)
        tables["nodes"].append({"label": n.label, "key": n.key, "at": at, "schema": n.df.schema.json(), "types": n.types, "defaults": _values(g.spark, n.defaults)})
    for t in (t for ts in g.rels.values() for t in ts):
        at = f"{path}/v{version}/rel-{t.type}-{t.src}-{t.dst}"
        df = t.df.sortWithinPartitions("_src", *([t.sort_key] if t.sort_key in t.props else []))
        df.write.mode("overwrite").parquet(at)
        t.df = g.spark.read.schema(t.df.schema).parquet(at)
        tables["rels"].append({"type": t.type, "src": t.src, "dst": t.dst, "multiplicity": t.multiplicity, "at": at, "schema": t.df.schema.json(), "types": t.types, "sort_key": t.sort_key, "defaults": _values(g.spark, t.defaults)})
    g.spark.createDataFrame([(json.dumps(tables),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest-v{version}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose manifests are committed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-v*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return [int(f.getPath().getParent().getName().removeprefix("manifest-v")) for f in found]


def _manifest(spark: SparkSession, path: str) -> dict | None:
    versions = _versions(spark, path)
    return json.loads(spark.read.text(f"{path}/manifest-v{max(versions)}").first()["value"]) if versions else None


def restore(spark: SparkSession, path: str) -> PropertyGraph | None:
    m = _manifest(spark, path)
    if m is None:
        return None
    g = PropertyGraph(spark)
    for n in m["nodes"]:
        schema = T.StructType.fromJson(json.loads(n["schema"]))
        g.add_node(n["label"], n["key"], spark.read.schema(schema).parquet(n["at"]), n["types"], _defaults(schema, n["types"], n["defaults"]))
    for r in m["rels"]:
        schema = T.StructType.fromJson(json.loads(r["schema"]))
        df = spark.read.schema(schema).parquet(r["at"])
        g.rels.setdefault(r["type"], []).append(RelTriplet(r["type"], r["src"], r["dst"], df.select("_src", "_dst", F.col("_eid"), *[c for c in df.columns if c not in ("_src", "_dst", "_eid")]), r["multiplicity"], r["types"], _defaults(schema, r["types"], r["defaults"]), r["sort_key"]))
    return g
