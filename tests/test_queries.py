"""Semantics on a small graph, with expectations worked out by hand or by brute force."""

import pytest
from graphs import KNOWS, PEOPLE, multigraph, tiny_social, walks

from weftgraph.operators.scope import BindError


@pytest.fixture(scope="module")
def c(spark):
    return tiny_social(spark)


def rows(c, q, **params):
    return sorted(c.execute(q, parameters=params).rows(), key=repr)


def test_multi_label_and_missing_property(c):
    assert rows(c, "MATCH (x:Person:Tool) WHERE x.age IS NULL RETURN x.name AS n") == [("loom",), ("plough",)]
    assert rows(c, "MATCH (x) RETURN label(x) AS l, count(*) AS n") == [("Person", 6), ("Tool", 2)]


def test_unknown_names_fail(c):
    for q in ("MATCH (x:Nobody) RETURN x", "MATCH (x:Person) RETURN x.nothing", "MATCH (x:Person)-[:HATES]->(y) RETURN x", "RETURN y", "RETURN nothing(1)", "MATCH (a:Person) RETURN a.name AS x, a.age AS x"):
        with pytest.raises(ValueError):
            c.execute(q).rows()


def test_homomorphism_walks(c):
    assert rows(c, "MATCH (a:Person {id: 1})-[k:KNOWS*3..3]->(b) RETURN count(*) AS n") == [(len(walks([(i, a, b, w) for i, (a, b, w) in enumerate(KNOWS)], 1, 3, 3)),)]
    assert rows(c, "MATCH (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(a) RETURN count(*) AS n") == [(12,)]


def test_undirected_and_label_inference(c):
    assert rows(c, "MATCH (a {id: 5})-[]-(b) RETURN b.name AS n") == [("dan",), ("fay",)]
    assert rows(c, "MATCH (a)-[:MADE]->(b) RETURN DISTINCT label(a) AS a, label(b) AS b") == [("Person", "Tool")]


def test_optional_keeps_rows_and_multiplicity(c):
    got = rows(c, "MATCH (p:Person) OPTIONAL MATCH (p)-[:MADE]->(t:Tool) WHERE t.stuff = 'wood' RETURN p.name AS p, t.name AS t")
    assert got == sorted([(n, "loom" if n in ("cat", "fay") else None) for _, n, _ in PEOPLE], key=repr)
    assert rows(c, "UNWIND [1, 1, 9] AS x OPTIONAL MATCH (p:Person {id: x}) RETURN x, p.name AS n") == [(1, "ann"), (1, "ann"), (9, None)]
    assert rows(c, "MATCH (a:Person)-[e:KNOWS]->(b:Person) WHERE a.id >= 4 OPTIONAL MATCH (b)-[:MADE]->(t) WHERE t.id > a.id + 6 RETURN a.id AS a, b.id AS b, t.id AS t") == [(4, 1, None), (4, 2, None), (4, 3, 11), (4, 5, None), (5, 6, None)]


def test_optional_null_node(c):
    assert rows(c, "MATCH (p:Person {id: 2}) OPTIONAL MATCH (p)-[:MADE]->(t) RETURN t, t IS NULL AS n, count(t) AS k") == [(None, True, 0)]


def test_exists(c):
    assert rows(c, "MATCH (p:Person) WHERE (p)-[:MADE]->() RETURN p.id AS i") == [(1,), (3,), (6,)]
    assert rows(c, "MATCH (p:Person) WHERE NOT EXISTS { MATCH (p)-[:MADE]->(t) WHERE t.stuff = 'iron' } AND p.age > 20 RETURN p.id AS i") == [(2,), (4,), (6,)]
    assert rows(c, "MATCH (p:Person) WHERE (p)-[:MADE]->() OR p.age < 20 RETURN p.id AS i") == [(1,), (3,), (5,), (6,)]
    assert rows(c, "MATCH (p:Person) RETURN p.id AS i, CASE WHEN (p)-[:MADE]->() THEN 'y' ELSE 'n' END AS m")[1] == (2, "n")


def test_three_valued_logic(c):
    q = "UNWIND [1, 2] AS x WITH CASE WHEN x = 1 THEN NULL ELSE true END AS a RETURN a AND false AS p, a OR true AS q, NOT a AS r"
    assert rows(c, q) == sorted([(False, True, None), (False, True, False)], key=repr)


def test_aggregates_skip_nulls_and_empty_input(c):
    assert rows(c, "MATCH (x:Person:Tool) RETURN count(*) AS a, count(x.age) AS b, sum(x.age) AS s, size(collect(x.age)) AS l") == [(8, 6, 200, 6)]
    assert rows(c, "MATCH (x:Person) WHERE x.id > 99 RETURN count(x) AS a, sum(x.age) AS s, collect(x.id) AS l") == [(0, None, [])]


def test_arithmetic(c):
    assert rows(c, "RETURN 70000 / 6 AS a, -7 / 2 AS b, -7 % 3 AS d, 7.0 / 2 AS e, 1.0 / 0 AS f, 2 ^ 3 AS g") == [(11666, -3, -1, 3.5, float("inf"), 8.0)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        rows(c, "RETURN 1 / 0 AS x")


def test_order_nulls_and_hidden_columns(c):
    got = c.execute("MATCH (x:Person:Tool) RETURN x.name AS n ORDER BY x.age, n LIMIT 3").rows()
    assert got == [("loom",), ("plough",), ("eve",)]
    got = c.execute("MATCH (x:Person:Tool) RETURN x.name AS n ORDER BY x.age DESC, n SKIP 6").rows()
    assert got == [("loom",), ("plough",)]


def test_lists(c):
    assert rows(c, "RETURN [10, 20, 30][1] AS a, [1, 'x'][1] AS b, [1, 2, 3][1..3] AS d, 2 IN [1, 2] AS e, list_contains(['a'], 'b') AS f") == [(20, "x", [2, 3], True, False)]
    assert rows(c, "RETURN all(x IN [1, 2] WHERE x > 0) AS a, any(x IN [1, 2] WHERE x > 5) AS b, none(x IN [1] WHERE x = 2) AS d, single(x IN [1, 1] WHERE x = 1) AS e") == [(True, False, True, False)]


def test_union_and_call(c):
    assert rows(c, "RETURN 1 AS x UNION RETURN 1 AS y") == [(1,)]
    assert rows(c, "RETURN 1 AS x UNION ALL RETURN 1 AS y") == [(1,), (1,)]
    got = rows(c, "MATCH (p:Person) CALL (p) { MATCH (p)-[:MADE]->(t) RETURN t.name AS n UNION ALL MATCH (p)-[:KNOWS]->(q:Person {id: 6}) RETURN q.name AS n } RETURN n, count(*) AS c")
    assert got == [("fay", 1), ("loom", 2), ("plough", 2)]


def test_parameters_and_bound_relationship(c):
    assert rows(c, "MATCH (p:Person) WHERE p.id IN $ids AND p.name <> $n RETURN p.id AS i", ids=[1, 2], n="bob") == [(1,)]
    with pytest.raises(BindError):
        c.execute("RETURN $missing AS x")
    assert rows(c, "MATCH (a:Person)-[e:KNOWS]->(b:Person {id: 6}) WITH e MATCH (x)-[e]->(y) RETURN x.id AS x, y.id AS y") == [(5, 6)]


def test_results(c):
    r = c.execute("MATCH (p:Person {id: 1})-[e:KNOWS]->(q {id: 2}) RETURN p, e, q.name")
    assert r.column_names == ["p", "e", "q.name"] and len(r) == 1
    assert r[0][0]["name"] == "ann" and r[0][0]["_LABEL"] == "Person" and r[0][1]["_LABEL"] == "KNOWS" and r[0][2] == "bob"
    assert r.to_arrow().num_rows == 1 and '"keys"' in r.get_bolt_response()
    assert "Join" in c.execute("EXPLAIN MATCH (p:Person)-[:KNOWS]->(q) RETURN q.name").rows()[0][0]


def test_unused_end_tables_are_not_joined(c):
    plan = c.execute("MATCH (p:Person)-[:KNOWS]->(q:Person) RETURN count(q) AS n").df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("mode", ["WALK", "TRAIL", "ACYCLIC"])
def test_paths_against_search(spark, seed, mode):
    c, edges = multigraph(spark, seed)
    for both, arrow in ((False, "->"), (True, "-")):
        want = sorted((p[0][-1], len(p[1])) for p in walks(edges, 0, 0, 3, mode, both))
        got = sorted(c.execute(f"MATCH (a:V {{id: 0}})-[k:E*{'' if mode == 'WALK' else mode} 0..3]{arrow}(b) RETURN b.id AS b, length(k) AS l").rows())
        assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_shortest_against_search(spark, seed):
    c, edges = multigraph(spark, seed)
    paths = walks(edges, 0, 1, 6)
    ends = {p[0][-1] for p in paths}
    length = {v: min(len(p[1]) for p in paths if p[0][-1] == v) for v in ends}
    assert dict(c.execute("MATCH (a:V {id: 0})-[k:E*SHORTEST 1..6]->(b) RETURN b.id AS b, length(k) AS l").rows()) == length
    number = {v: sum(p[0][-1] == v and len(p[1]) == length[v] for p in paths) for v in ends}
    assert dict(c.execute("MATCH (a:V {id: 0})-[k:E*ALL SHORTEST 1..6]->(b) RETURN b.id AS b, count(*) AS n").rows()) == number
    w = {e: x for e, _, _, x in edges}
    cost = {v: min(sum(w[e] for e in p[1]) for p in paths if p[0][-1] == v) for v in ends if v != 0}
    assert dict(c.execute("MATCH (a:V {id: 0})-[k:E*WSHORTEST(w) 1..6]->(b) WHERE b <> a RETURN b.id AS b, cost(k) AS c").rows()) == cost


def test_path_functions(c):
    got = rows(c, "MATCH (a:Person {id: 4})-[k:KNOWS*2..2]->(b:Person {id: 6}) RETURN properties(nodes(k), 'name') AS n, properties(rels(k), 'w') AS w, is_trail(k) AS t, is_acyclic(k) AS y")
    assert got == [(["dan", "eve", "fay"], [1.5, 0.5], True, True)]
    assert rows(c, "MATCH p = (a:Person {id: 5})-[e:KNOWS]->(b) RETURN length(p) AS l, label(nodes(p)[1]) AS n") == [(1, "Person")]


@pytest.mark.parametrize("pattern", ["(a:V)-[:E]->(b)-[:E]->(c)", "(a:V)-[:E]-(b), (b)-[:E]->(c {k: 1}), (d)-[:E]->(b)", "(a:V)<-[e:E]-(b)-[f:E]->(c)"])
def test_counting_by_weights_against_enumeration(spark, pattern):
    c, _ = multigraph(spark, 9)
    names = [n for n in "abcd" if f"({n}" in pattern]
    where = " WHERE b.k < 2" + (" AND e.w > 2" if "[e" in pattern else "")
    all_rows = c.execute(f"MATCH {pattern}{where} RETURN {', '.join(f'{n}.id AS {n}' for n in names)}").rows()
    assert c.execute(f"MATCH {pattern}{where} RETURN count(*) AS n").rows() == [(len(all_rows),)]
    by_b = {}
    for r in all_rows:
        by_b[r[names.index("b")]] = by_b.get(r[names.index("b")], 0) + 1
    assert dict(c.execute(f"MATCH {pattern}{where} RETURN b.id AS b, count(*) AS n ORDER BY n DESC").rows()) == by_b
    plan = c.execute(f"MATCH {pattern}{where} RETURN count(*) AS n").df._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" in plan
