"""A property graph over the TPC-H-like tables, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import PropertyGraph
from .session import GraphDatabase


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    g = PropertyGraph(spark)
    events = t("events")
    for label, key, df in (
        ("Region", "r_regionkey", t("region")),
        ("Nation", "n_nationkey", t("nation")),
        ("Customer", "c_custkey", t("customer")),
        ("Supplier", "s_suppkey", t("supplier")),
        ("Part", "p_partkey", t("part")),
        ("Orders", "o_orderkey", t("orders")),
        ("User", "user_id", events.select("user_id").distinct()),
        ("Event", "event_id", events),
    ):
        g.add_node(label, key, df)
    lines = t("lineitem")
    rename = {c: c[2:] for c in lines.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey")}
    items = lines.withColumnsRenamed(rename)
    props = list(rename.values())
    g.add_rel("IN_REGION", "Nation", "Region", t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", "MANY_TO_ONE")
    g.add_rel("IN_NATION", "Customer", "Nation", t("customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", "MANY_TO_ONE")
    g.add_rel("IN_NATION", "Supplier", "Nation", t("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", "MANY_TO_ONE")
    g.add_rel("PLACED", "Customer", "Orders", t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "ONE_TO_MANY")
    g.add_rel("CONTAINS", "Orders", "Part", items.select("l_orderkey", "l_partkey", *props), "l_orderkey", "l_partkey")
    g.add_rel("SHIPPED_BY", "Orders", "Supplier", items.select("l_orderkey", "l_suppkey", *props), "l_orderkey", "l_suppkey")
    g.add_rel("SUPPLIES", "Supplier", "Part", lines.select("l_suppkey", "l_partkey").distinct().withColumn("_eid", F.xxhash64("l_suppkey", "l_partkey")), "l_suppkey", "l_partkey")
    g.add_rel("DID", "User", "Event", events.select("user_id", "event_id"), "user_id", "event_id", "ONE_TO_MANY")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g.add_rel("NEXT", "Event", "Event", events.select("event_id", after.alias("next_id")).where("next_id IS NOT NULL"), "event_id", "next_id", "ONE_TO_ONE")
    # a network that grows with the tables: each order refers its customer to another one
    keys = t("customer").agg(F.min("c_custkey").alias("low"), F.count(F.lit(1)).alias("n")).first()
    other = F.lit(keys["low"]) + F.pmod(F.col("o_orderkey") * 7919 + F.col("o_custkey") * 31, F.lit(max(1, keys["n"])))
    refers = t("orders").select("o_custkey", other.alias("other"), (F.col("o_orderkey") % 9 + 1).alias("w"), F.col("o_orderkey").alias("_eid"))
    g.add_rel("REFERS", "Customer", "Customer", refers, "o_custkey", "other")
    n, m = F.col("n_nationkey"), F.col("m")
    linked = t("nation").select(n, F.explode(F.array((2 * n + 1) % 25, (n + 7) % 25)).alias("m"))
    linked = linked.select(n, m, ((7 * n + 3 * m) % 10 + 1).alias("w"), (n * 100 + m).cast("long").alias("_eid"))
    g.add_rel("LINKED", "Nation", "Nation", linked, "n_nationkey", "m")
    return g


_GRAPHS: dict[tuple[str, str], PropertyGraph] = {}


def database(spark: SparkSession, sf_dir: str) -> GraphDatabase:
    """A database over the tables; footers are read once a session, changes stay in the database."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = graph(spark, sf_dir)
    return GraphDatabase(spark, graph=_GRAPHS[key].copy())
