import json

import pytest
from graphs import tiny_social

from weftgraph.catalog import CatalogError
from weftgraph.session import GraphDatabase


def test_create_set_delete(spark):
    c = tiny_social(spark)
    c.execute("CREATE (p:Person {id: 7, name: 'gil'})-[:KNOWS {w: 9.5}]->(q:Person {id: 8})")
    assert c.execute("MATCH (p:Person {id: 7})-[e:KNOWS]->(q) RETURN e.w AS w, q.name AS n, q.age AS a").rows() == [(9.5, "", 0)]
    c.execute("MATCH (p:Person) WHERE p.age < 20 SET p.age = p.age + 100")
    assert sorted(c.execute("MATCH (p:Person) WHERE p.age >= 100 RETURN p.id AS i, p.age AS a").rows()) == [(5, 119), (7, 100), (8, 100)]
    c.execute("MATCH (p:Person {id: 3}) DELETE p")
    assert c.execute("MATCH (p:Person)-[e]->(q) RETURN count(*) AS n").rows() == [(14 - 6 + 1 + 2,)]
    c.execute("MATCH (:Person {id: 7})-[e:KNOWS]->() DELETE e")
    assert c.execute("MATCH (:Person {id: 7})-[e:KNOWS]->() RETURN count(e) AS n").rows() == [(0,)]


def test_keys_and_ends_are_checked(spark):
    c = tiny_social(spark)
    with pytest.raises(CatalogError):
        c.execute("CREATE (p:Person {id: 1})")
    with pytest.raises(CatalogError):
        c.execute("UNWIND [50, 50] AS k CREATE (p:Person {id: k})")
    c.db.register_table("bad", spark.createDataFrame([(1, 99, 0.5)], "a long, b long, w double"))
    with pytest.raises(CatalogError):
        c.execute("COPY KNOWS FROM bad")


def test_statement_sees_the_state_before_it(spark):
    c = tiny_social(spark)
    c.execute("MATCH (p:Person) CREATE (q:Person {id: p.id + 100})")
    assert c.execute("MATCH (p:Person) RETURN count(*) AS n").rows() == [(12,)]


def test_read_only_and_schema(spark):
    db = GraphDatabase(spark, mode="r")
    with pytest.raises(PermissionError):
        db.connect().execute("CREATE NODE TABLE x(id INT64, PRIMARY KEY(id))")
    c = tiny_social(spark)
    assert [n["label"] for n in c.get_schema()["nodes"]] == ["Person", "Tool"]


def test_files(spark, tmp_path):
    c = tiny_social(spark)
    c.execute(f"COPY (MATCH (p:Person) RETURN p.id AS id, p.name + ',\"x\"' AS name) TO '{tmp_path}/p.csv' (delim=',')")
    got = sorted(c.execute(f"LOAD FROM '{tmp_path}/p.csv' (delim=',') RETURN id, name").rows())
    assert got[0] == (1, 'ann,"x"')
    c.execute(f"COPY (MATCH (p:Person) RETURN p.id AS id, p.name AS name) TO '{tmp_path}/p.json'")
    arrays = [json.loads(f.read_text()) for f in (tmp_path / "p.json").glob("part-*")]  # each part is an array by itself
    assert sorted(x["id"] for a in arrays for x in a) == [1, 2, 3, 4, 5, 6]
    assert c.execute(f"LOAD FROM '{tmp_path}/p.json' RETURN count(*) AS n, max(name) AS m").rows() == [(6, "fay")]
    c.execute(f"COPY Copied FROM '{tmp_path}/p.json'")
    assert c.execute("MATCH (p:Copied) RETURN count(p) AS n").rows() == [(6,)]


def test_checkpoint_round_trip(spark, tmp_path):
    c = tiny_social(spark)
    c.db.path = str(tmp_path / "g")
    c.execute("CHECKPOINT")
    again = GraphDatabase(spark, str(tmp_path / "g")).connect()
    assert again.execute("MATCH (a:Person)-[e:KNOWS]->(b) RETURN count(*) AS n, round(sum(e.w), 3) AS w").rows() == c.execute("MATCH (a:Person)-[e:KNOWS]->(b) RETURN count(*) AS n, round(sum(e.w), 3) AS w").rows()


def test_functions_can_be_added(spark):
    c = tiny_social(spark)
    c.db.register_function("twice", lambda x: x * 2)
    c.db.register_table_function("people", lambda g, n: g.nodes["Person"].df.limit(n))
    assert c.execute("RETURN twice(21) AS x").rows() == [(42,)]
    assert c.execute("CALL people(2) YIELD name RETURN count(*) AS n").rows() == [(2,)]
