"""Shortest paths between given ends, from one end, and trails, against plain loops over random multigraphs."""

import random
from collections import Counter

import pytest

from weftgraph.catalog import PropertyGraph
from weftgraph.session import GraphDatabase


def random_multigraph(spark, seed):
    r = random.Random(seed)
    n = r.randint(4, 7)
    edges = [(r.randrange(n), r.randrange(n), r.randint(1, 3)) for _ in range(r.randint(6, 14))]
    g = PropertyGraph(spark)
    g.add_node("V", "id", spark.createDataFrame([(i, i % 3) for i in range(n)], "id long, grade int"))
    g.add_rel("E", "V", "V", spark.createDataFrame(edges, "a long, b long, w int"), "a", "b")
    return GraphDatabase(spark, graph=g).connect(), n, edges


def walks(edges, start, most, inner=lambda v: True):
    """All walks of 1 to ``most`` edges, as lists of edge numbers, whose inner nodes fulfil a condition."""
    now = [([], start)]
    for _ in range(most):
        now = [([*w, i], b) for w, v in now if not w or inner(v) for i, (a, b, _) in enumerate(edges) if a == v]
        yield from now


def shortest(edges, a, most, inner=lambda v: True):
    """End to (length, number of shortest walks)."""
    out = {}
    for w, b in walks(edges, a, most, inner):
        if b not in out or len(w) == out[b][0]:
            out[b] = (len(w), out.get(b, (0, 0))[1] + 1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_shortest_with_both_ends_given(spark, seed):
    c, n, edges = random_multigraph(spark, seed)
    want = {(a, b): x for a in range(n) for b, x in shortest(edges, a, 4).items()}
    one = c.execute("MATCH (a:V), (b:V) MATCH (a)-[k:E*SHORTEST 1..4]->(b) RETURN a.id AS a, b.id AS b, length(k) AS len").rows()
    assert sorted(one) == sorted((a, b, x[0]) for (a, b), x in want.items())
    many = c.execute("MATCH (a:V), (b:V) MATCH (a)-[k:E*ALL SHORTEST 1..4]->(b) RETURN a.id AS a, b.id AS b, length(k) AS len, count(*) AS n").rows()
    assert sorted(many) == sorted((a, b, *x) for (a, b), x in want.items())
    paths = c.execute("MATCH (a:V), (b:V) MATCH (a)-[k:E*SHORTEST 1..4]->(b) RETURN a.id AS a, b.id AS b, nodes(k) AS nodes, rels(k) AS rels").rows()
    assert len(paths) == len(want)
    for a, b, nodes, rels in paths:
        ids = [v["_id"] for v in nodes]
        assert ids[0] == a and ids[-1] == b and len(rels) == want[a, b][0] == len(ids) - 1
        assert [(e["_src"], e["_dst"]) for e in rels] == list(zip(ids, ids[1:], strict=False))


def test_shortest_with_a_condition_on_inner_nodes(spark):
    c, n, edges = random_multigraph(spark, 5)
    want = {(a, b): x for a in range(n) for b, x in shortest(edges, a, 4, lambda v: v % 3 != 1).items()}
    got = c.execute("MATCH (a:V), (b:V) MATCH (a)-[k:E*SHORTEST 1..4 (r, v | WHERE v.grade <> 1)]->(b) RETURN a.id AS a, b.id AS b, length(k) AS len").rows()
    assert sorted(got) == sorted((a, b, x[0]) for (a, b), x in want.items())


def test_a_limit_by_length_stops_early_with_the_same_rows(spark):
    c, n, edges = random_multigraph(spark, 1)
    everything = c.execute("MATCH (a:V)-[k:E*SHORTEST 1..4]->(b:V) WHERE a.id < 3 RETURN a.id AS a, b.id AS b, length(k) AS len ORDER BY length(k), a, b").rows()
    for k in (1, 3, 100):
        assert c.execute(f"MATCH (a:V)-[k:E*SHORTEST 1..4]->(b:V) WHERE a.id < 3 RETURN a.id AS a, b.id AS b, length(k) AS len ORDER BY length(k), a, b LIMIT {k}").rows() == everything[:k]


def test_equal_parallel_edges_are_different_edges(spark):
    g = PropertyGraph(spark)
    g.add_node("V", "id", spark.createDataFrame([(1,), (2,)], "id long"))
    g.add_rel("E", "V", "V", spark.createDataFrame([(1, 2, 0), (1, 2, 0), (2, 1, 5)], "a long, b long, w int"), "a", "b")
    c = GraphDatabase(spark, graph=g).connect()
    want = Counter()
    edges = [(1, 2, 0), (1, 2, 0), (2, 1, 5)]
    for w, _ in walks(edges, 1, 3):
        want[len(w)] += len(set(w)) == len(w)
    got = dict(c.execute("MATCH (a:V {id: 1})-[k:E*TRAIL 1..3]->(b) RETURN length(k) AS len, count(*) AS n").rows())
    assert got == {k: v for k, v in want.items() if v}


def test_paths_are_in_the_order_of_the_pattern(spark):
    c, n, edges = random_multigraph(spark, 2)
    for a, b, nodes in c.execute("MATCH (a:V)-[k:E*1..2]->(b:V {id: 0}) RETURN a.id AS a, b.id AS b, nodes(k) AS nodes").rows():
        assert nodes[0]["_id"] == a and nodes[-1]["_id"] == b == 0
    for a, length, size in c.execute("MATCH p = (a:V)-[:E]->(b:V)-[:E*1..2]->(c:V {id: 0}) RETURN a.id AS a, length(p) AS len, size(nodes(p)) AS n").rows():
        assert size == length + 1
