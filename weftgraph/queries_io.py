"""Named queries that read and write files, define and change graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .operators.paths import shared_folder
from .session import Connection, GraphDatabase
from .testgraph import database


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


def _tables(spark: SparkSession, sf_dir: str) -> Connection:
    """A new graph of nations, customers and suppliers loaded by COPY."""
    c = GraphDatabase(spark).connect()
    for q in (
        "CREATE NODE TABLE Nation(n_nationkey INT32, n_name STRING, n_regionkey INT32, PRIMARY KEY(n_nationkey))",
        "CREATE NODE TABLE Supplier(s_suppkey INT64, s_name STRING, s_acctbal DOUBLE, note STRING DEFAULT 'none', PRIMARY KEY(s_suppkey))",
        "CREATE REL TABLE IN_NATION(FROM Supplier TO Nation, since INT32 DEFAULT 1990, MANY_TO_ONE)",
        f"COPY Nation FROM '{sf_dir}/nation.parquet'",
        f"COPY Supplier FROM (LOAD FROM '{sf_dir}/supplier.parquet' RETURN s_suppkey, s_name, s_acctbal)",
        f"COPY IN_NATION FROM (LOAD FROM '{sf_dir}/supplier.parquet' WHERE s_nationkey IS NOT NULL RETURN s_suppkey, s_nationkey)",
    ):
        c.execute(q)
    return c


def load_from_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).connect().execute(f"LOAD FROM '{sf_dir}/customer.parquet' WHERE c_acctbal > 0 RETURN c_mktsegment AS seg, count(*) AS cnt, round(sum(c_acctbal), 2) AS bal").df


def load_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, at = database(spark, sf_dir).connect(), _folder(spark)
    c.execute(f"COPY (MATCH (p:Part) RETURN p.p_partkey AS k, p.p_name AS name, p.p_size AS size) TO '{at}/part.csv' (HEADER=true, DELIM=',')")
    return c.execute(f"LOAD FROM '{at}/part.csv' (header=true, delim=',') WHERE CAST(size, 'INT64') > 20 RETURN CAST(size AS INT32) AS size, count(*) AS cnt, max(name) AS name").df


def load_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, at = database(spark, sf_dir).connect(), _folder(spark)
    c.execute(f"COPY (MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name) TO '{at}/nation.json'")
    return c.execute(f"LOAD FROM '{at}/nation.json' WHERE k < 20 RETURN name, k AS k").df


def load_from_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, at = database(spark, sf_dir).connect(), _folder(spark)
    c.execute(f"COPY (MATCH (s:Supplier) RETURN s.s_suppkey AS k, s.s_acctbal AS b) TO '{at}/supplier.jsonl'")
    return c.execute(f"LOAD FROM '{at}/supplier.jsonl' RETURN k % 10 AS m, round(sum(b), 2) AS b").df


def load_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, at = database(spark, sf_dir).connect(), _folder(spark)
    c.execute(f"COPY (MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name) TO '{at}/nation.csv' (header=false)")
    return c.execute(f"LOAD WITH HEADERS (key INT64, name STRING) FROM '{at}/nation.csv' (header=false) RETURN key, upper(name) AS name").df


def copy_graph_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and relationships are exported as JSON texts."""
    c, at = database(spark, sf_dir).connect(), _folder(spark)
    c.execute(f"COPY (MATCH (a:Nation)-[e:LINKED]->(b:Nation) RETURN a, e.w AS w) TO '{at}/linked.csv'")
    return c.execute(f"LOAD FROM '{at}/linked.csv' WHERE a CONTAINS '\"_LABEL\":\"Nation\"' RETURN count(*) AS cnt, sum(w) AS w").df


def copy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).execute("MATCH (s:Supplier)-[e:IN_NATION]->(n:Nation) RETURN n.n_name AS n, s.note AS note, e.since AS since, count(*) AS cnt, round(sum(s.s_acctbal), 2) AS bal").df


def copy_auto_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = GraphDatabase(spark).connect()
    c.execute(f"COPY Region FROM '{sf_dir}/region.parquet'")
    c.execute(f"COPY Nation FROM '{sf_dir}/nation.parquet'")
    c.execute(f"COPY IN_REGION FROM (LOAD FROM '{sf_dir}/nation.parquet' RETURN n_nationkey, n_regionkey) (from='Nation', to='Region')")
    return c.execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(n) AS cnt").df


def ddl_alter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tables(spark, sf_dir)
    for q in (
        "ALTER TABLE Nation ADD grade INT64 DEFAULT 7",
        "ALTER TABLE Nation ADD tag STRING",
        "ALTER TABLE Nation RENAME n_name TO name",
        "ALTER TABLE Nation DROP n_regionkey",
        "ALTER TABLE IN_NATION ADD w DOUBLE DEFAULT 0.5",
        "ALTER TABLE Nation RENAME TO Country",
    ):
        c.execute(q)
    return c.execute("MATCH (s:Supplier)-[e:IN_NATION]->(n:Country) RETURN n.name AS name, n.grade AS grade, n.tag AS tag, sum(e.w) AS w").df


def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tables(spark, sf_dir)
    c.execute("DROP TABLE Nation")
    c.execute("DROP TABLE IF EXISTS Nothing")
    return c.execute("CALL show_tables() YIELD name, type RETURN name, type").df


def ddl_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{_folder(spark)}/graph"
    c = _tables(spark, sf_dir)
    c.db.path = at
    c.execute("CHECKPOINT")
    return GraphDatabase(spark, at, "r").connect().execute("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) RETURN n.n_nationkey AS n, count(*) AS cnt").df


def ddl_checkpoint_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared defaults hold in a graph that is opened again, and the last of several checkpoints counts."""
    at = f"{_folder(spark)}/graph"
    c = _tables(spark, sf_dir)
    c.db.path = at
    c.execute("CHECKPOINT")
    c.execute("MATCH (s:Supplier) SET s.note = 'old'")
    c.execute("CHECKPOINT")
    c = GraphDatabase(spark, at).connect()
    c.execute("CREATE (s:Supplier {s_suppkey: -9, s_name: 'new'})")
    c.execute("MATCH (s:Supplier {s_suppkey: -9}), (n:Nation {n_nationkey: 1}) CREATE (s)-[:IN_NATION]->(n)")
    return c.execute("MATCH (s:Supplier)-[e:IN_NATION]->(:Nation) RETURN s.note AS note, e.since AS since, count(*) AS cnt").df


def load_from_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files by a pattern."""
    c, at = database(spark, sf_dir).connect(), _folder(spark)
    for i in range(2):
        c.execute(f"COPY (MATCH (n:Nation) WHERE n.n_nationkey % 2 = {i} RETURN n.n_nationkey AS k, n.n_name AS name) TO '{at}/nation-{i}.csv' (header=true, delim=',')")
    return c.execute(f"LOAD FROM '{at}/nation-*.csv' (header=true, delim=',') RETURN name, k AS k").df


def dml_merge_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers below 10 have an edge to their own nation: one to nation 1 is matched, the others are created."""
    c = _tables(spark, sf_dir)
    c.execute("MATCH (s:Supplier), (n:Nation {n_nationkey: 1}) WHERE s.s_suppkey < 10 MERGE (s)-[e:IN_NATION]->(n) ON MATCH SET e.since = 1 ON CREATE SET e.since = 2")
    c.execute("MERGE (s:Supplier {s_suppkey: -1})-[:IN_NATION {since: 5}]->(n:Nation {n_nationkey: 500})")
    c.execute("MERGE (s:Supplier {s_suppkey: -1})-[:IN_NATION {since: 5}]->(n:Nation {n_nationkey: 500})")
    return c.execute("MATCH (s:Supplier)-[e:IN_NATION]->(n:Nation) WHERE s.s_suppkey < 10 RETURN s.s_suppkey AS s, n.n_nationkey AS n, e.since AS since").df


def dml_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tables(spark, sf_dir)
    c.execute("CREATE (n:Nation {n_nationkey: 100, n_name: 'NEW'})")
    c.execute("MATCH (n:Nation {n_nationkey: 100}), (s:Supplier) WHERE s.s_suppkey < 4 CREATE (s)-[:IN_NATION {since: 2020}]->(n)")
    c.execute("UNWIND [101, 102] AS k CREATE (n:Nation {n_nationkey: k, n_name: 'N' + CAST(k AS STRING), n_regionkey: 1})")
    return c.execute("MATCH (n:Nation) WHERE n.n_nationkey >= 100 OPTIONAL MATCH (n)<-[e:IN_NATION]-(s:Supplier) RETURN n.n_nationkey AS n, n.n_name AS name, n.n_regionkey AS r, count(s) AS s, max(e.since) AS since").df


def dml_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tables(spark, sf_dir)
    c.execute("MATCH (s:Supplier)-[e:IN_NATION]->(n:Nation) WHERE n.n_nationkey < 10 SET s.note = n.n_name, e.since = 2000 + n.n_nationkey")
    return c.execute("MATCH (s:Supplier)-[e:IN_NATION]->(:Nation) RETURN s.note AS note, e.since AS since, count(*) AS cnt").df


def dml_delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tables(spark, sf_dir)
    c.execute("MATCH (s:Supplier)-[e:IN_NATION]->(n:Nation) WHERE s.s_acctbal < 0 DELETE e")
    return c.execute("MATCH (s:Supplier) OPTIONAL MATCH (s)-[e:IN_NATION]->(:Nation) RETURN count(s) AS s, count(e) AS e").df


def dml_detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tables(spark, sf_dir)
    c.execute("MATCH (n:Nation) WHERE n.n_nationkey < 10 DETACH DELETE n")
    return c.execute("MATCH (s:Supplier) OPTIONAL MATCH (s)-[e:IN_NATION]->(n:Nation) RETURN count(s) AS s, count(e) AS e, min(n.n_nationkey) AS least").df


def dml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tables(spark, sf_dir)
    c.execute("UNWIND [1, 2, 200] AS k MERGE (n:Nation {n_nationkey: k}) ON MATCH SET n.n_name = 'old' ON CREATE SET n.n_name = 'new'")
    return c.execute("MATCH (n:Nation) WHERE n.n_name = 'old' OR n.n_name = 'new' RETURN n.n_nationkey AS n, n.n_name AS name").df


def macro_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = database(spark, sf_dir).connect()
    c.execute("CREATE MACRO grown(x, by := 2) AS x * by + 1")
    return c.execute("MATCH (p:Part) RETURN p.p_partkey AS k, grown(p.p_size) AS a, grown(p.p_size, 10) AS b").df


def load_graph_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph loaded by a specification of its tables."""
    db = GraphDatabase(spark)
    db.load_graph({
        "nodes": [
            {"label": "Region", "key": "r_regionkey", "columns": {"r_regionkey": "INT32", "r_name": "STRING"}, "source": f"{sf_dir}/region.parquet"},
            {"label": "Nation", "key": "n_nationkey", "columns": {"n_nationkey": "INT32", "n_name": "STRING", "n_regionkey": "INT32"}, "source": f"{sf_dir}/nation.parquet"},
        ],
        "relationships": [{"type": "IN_REGION", "from": "Nation", "to": "Region", "multiplicity": "MANY_TO_ONE", "source": spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")}],
    })
    return db.connect().execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(n) AS cnt, max(n.n_name) AS last").df


def call_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).connect().execute("CALL show_loaded_extensions() YIELD name AS ext RETURN ext").df


QUERIES = {
    f.__name__: f
    for f in (
        load_from_parquet, load_from_csv, load_from_json, load_from_jsonl, load_with_headers, copy_graph_values, copy_roundtrip, copy_auto_detect,
        ddl_alter_default, ddl_drop, ddl_checkpoint, dml_create, dml_set, dml_delete_edges, dml_detach_delete, dml_merge, call_extensions,
        ddl_checkpoint_defaults, load_from_glob, dml_merge_rel, macro_call, load_graph_spec,
    )
}

ORACLE_SQL = {
    "load_from_parquet": "SELECT c_mktsegment AS seg, count(*) AS cnt, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "load_from_csv": "SELECT p_size AS size, count(*) AS cnt, max(p_name) AS name FROM part WHERE p_size > 20 GROUP BY 1",
    "load_from_json": "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey < 20",
    "load_from_jsonl": "SELECT s_suppkey % 10 AS m, round(sum(s_acctbal), 2) AS b FROM supplier GROUP BY 1",
    "load_with_headers": "SELECT CAST(n_nationkey AS BIGINT) AS key, upper(n_name) AS name FROM nation",
    "copy_graph_values": "SELECT count(*) AS cnt, CAST(sum((7 * n_nationkey + 3 * m) % 10 + 1) AS BIGINT) AS w FROM (SELECT n_nationkey, unnest([(2 * n_nationkey + 1) % 25, (n_nationkey + 7) % 25]) AS m FROM nation)",
    "copy_roundtrip": "SELECT n_name AS n, 'none' AS note, CAST(1990 AS INTEGER) AS since, count(*) AS cnt, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "copy_auto_detect": "SELECT r_name AS r, count(*) AS cnt FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "ddl_alter_default": "SELECT n_name AS name, CAST(7 AS BIGINT) AS grade, '' AS tag, count(*) * CAST(0.5 AS DOUBLE) AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "ddl_drop": "SELECT 'Supplier' AS name, 'NODE' AS type",
    "ddl_checkpoint": "SELECT s_nationkey AS n, count(*) AS cnt FROM supplier GROUP BY 1",
    "dml_create": "SELECT 100::INTEGER AS n, 'NEW' AS name, 0::INTEGER AS r, 3::BIGINT AS s, 2020::INTEGER AS since WHERE false UNION ALL SELECT 100, 'NEW', 0, (SELECT count(*) FROM supplier WHERE s_suppkey < 4), 2020 UNION ALL SELECT 101, 'N101', 1, 0, NULL UNION ALL SELECT 102, 'N102', 1, 0, NULL",
    "dml_set": "SELECT CASE WHEN n_nationkey < 10 THEN n_name ELSE 'none' END AS note, CAST(CASE WHEN n_nationkey < 10 THEN 2000 + n_nationkey ELSE 1990 END AS INTEGER) AS since, count(*) AS cnt FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "dml_delete_edges": "SELECT count(*) AS s, count(*) FILTER (s_acctbal >= 0) AS e FROM supplier",
    "dml_detach_delete": "SELECT count(*) AS s, count(*) FILTER (s_nationkey >= 10) AS e, min(s_nationkey) FILTER (s_nationkey >= 10) AS least FROM supplier",
    "dml_merge": "SELECT 1::INTEGER AS n, 'old' AS name UNION ALL SELECT 2, 'old' UNION ALL SELECT 200, 'new'",
    "ddl_checkpoint_defaults": "SELECT 'old' AS note, 1990::INTEGER AS since, count(*) AS cnt FROM supplier UNION ALL SELECT 'none', 1990, 1",
    "macro_call": "SELECT p_partkey AS k, p_size * 2 + 1 AS a, p_size * 10 + 1 AS b FROM part",
    "load_graph_spec": "SELECT r_name AS r, count(*) AS cnt, max(n_name) AS last FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "load_from_glob": "SELECT n_name AS name, n_nationkey AS k FROM nation",
    "dml_merge_rel": "SELECT s_suppkey AS s, s_nationkey AS n, CASE WHEN s_nationkey = 1 THEN 1 ELSE 1990 END::INTEGER AS since FROM supplier WHERE s_suppkey < 10 UNION ALL SELECT s_suppkey, 1, 2 FROM supplier WHERE s_suppkey < 10 AND s_nationkey <> 1 UNION ALL SELECT -1, 500, 5",
    "call_extensions": "SELECT unnest(['csv', 'json', 'parquet']) AS ext",
}
