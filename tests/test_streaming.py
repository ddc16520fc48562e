from weftgraph.session import GraphDatabase
from weftgraph.streaming.ingest import load_nodes, load_rels


def test_streams_become_tables_and_replays_add_nothing(spark, tmp_path):
    db = GraphDatabase(spark)
    c = db.connect()
    c.execute("CREATE NODE TABLE P(id INT64, name STRING, PRIMARY KEY(id))")
    c.execute("CREATE REL TABLE R(FROM P TO P, w DOUBLE)")
    nodes, rels = str(tmp_path / "n"), str(tmp_path / "r")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, name string").write.parquet(nodes)
    spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5)], "_src long, _dst long, w double").write.parquet(rels)

    def node_stream():
        return spark.readStream.schema("id long, name string").parquet(nodes)

    load_nodes(db, "P", node_stream(), str(tmp_path / "c1")).awaitTermination()
    spark.createDataFrame([(2, "again"), (3, "c")], "id long, name string").write.mode("append").parquet(nodes)
    load_nodes(db, "P", node_stream(), str(tmp_path / "c1")).awaitTermination()
    load_nodes(db, "P", node_stream(), str(tmp_path / "c2")).awaitTermination()  # everything once more
    assert sorted(c.execute("MATCH (p:P) RETURN p.id AS i, p.name AS n").rows()) == [(1, "a"), (2, "b"), (3, "c")]
    stream = spark.readStream.schema("_src long, _dst long, w double").parquet(rels)
    for k in ("c3", "c4"):
        load_rels(db, "R", "P", "P", stream, str(tmp_path / k)).awaitTermination()
    assert c.execute("MATCH (a:P)-[e:R]->(b:P) RETURN count(*) AS n, sum(e.w) AS w").rows() == [(2, 1.0)]
