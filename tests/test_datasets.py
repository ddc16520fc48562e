"""Bulk loading by specifications, the small graphs, and macros."""

import json

import pytest

from weftgraph.catalog import CatalogError
from weftgraph.operators.scope import BindError
from weftgraph.session import GraphDatabase


def test_builtin_datasets(spark):
    c = GraphDatabase.from_builtin_dataset(spark, "modern").connect()
    assert c.execute("MATCH (a:person)-[e:created]->(s:software) RETURN s.name AS s, count(*) AS n ORDER BY s").rows() == [("lop", 3), ("ripple", 1)]
    c.db.load_builtin_dataset("trade")
    assert c.execute("MATCH (a:town {id: 0})-[k:road*WSHORTEST(miles) 1..5]->(b:town {id: 3}) RETURN cost(k) AS miles").rows() == [(9.0,)]
    with pytest.raises(ValueError):
        c.db.load_builtin_dataset("nothing")


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_graph_from_a_specification(spark, tmp_path, kind):
    (tmp_path / "p1.csv").write_text("id|name\n1|ann\n2|bob\n")
    (tmp_path / "p2.csv").write_text("id|name\n3|cat\n")
    (tmp_path / "k.csv").write_text("a,b,w\n1,2,0.5\n2,3,1.5\n")
    spec = {
        "nodes": [{"label": "P", "key": "id", "columns": {"id": "INT64", "name": "STRING"}, "source": ["p1.csv", "p2.csv"]}, {"label": "Q", "key": "id", "columns": {"id": "INT64"}}],
        "relationships": [{"type": "K", "from": "P", "to": "P", "columns": {"w": "DOUBLE"}, "source": "k.csv", "options": {"delim": ","}}],
    }
    if kind == "yaml":
        pytest.importorskip("yaml")
    path = tmp_path / f"graph.{kind}"
    path.write_text(json.dumps(spec))  # JSON is YAML, too
    db = GraphDatabase(spark)
    db.load_graph(str(path))
    assert db.connect().execute("MATCH (a:P)-[e:K]->(b:P) RETURN a.name AS a, e.w AS w, b.name AS b ORDER BY a").rows() == [("ann", 0.5, "bob"), ("bob", 1.5, "cat")]
    assert db.connect().execute("MATCH (q:Q) RETURN count(*) AS n").rows() == [(0,)]


def test_macros(spark):
    c = GraphDatabase.from_builtin_dataset(spark, "modern").connect()
    c.execute("CREATE MACRO older(x, by := 10) AS x + by")
    c.execute("CREATE MACRO both(x, by) AS older(by, x) * 2")
    assert c.execute("MATCH (p:person {id: 1}) RETURN older(p.age) AS a, older(p.age, 1) AS b, both(1, p.age) AS c").rows() == [(39, 30, 60)]
    with pytest.raises(BindError):
        c.execute("RETURN both(1) AS a")
    with pytest.raises(CatalogError):
        c.execute("CREATE MACRO older(x) AS x")
