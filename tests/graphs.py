"""Small hand-made graphs, and brute force over them."""

import random

from weftgraph.session import GraphDatabase

PEOPLE = [(1, "ann", 30), (2, "bob", 25), (3, "cat", 41), (4, "dan", 25), (5, "eve", 19), (6, "fay", 60)]
TOOLS = [(10, "plough", "iron"), (11, "loom", "wood")]
KNOWS = [(a, b, 0.1 * a + b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a != b] + [(4, 5, 1.5), (5, 6, 0.5)]
MADE = [(1, 10), (3, 10), (3, 11), (6, 11)]


def tiny_social(spark):
    db = GraphDatabase(spark)
    g = db.graph
    g.add_node("Person", "id", spark.createDataFrame(PEOPLE, "id long, name string, age int"))
    g.add_node("Tool", "id", spark.createDataFrame(TOOLS, "id long, name string, stuff string"))
    g.add_rel("KNOWS", "Person", "Person", spark.createDataFrame([(*e, i) for i, e in enumerate(KNOWS)], "_src long, _dst long, w double, _eid long"))
    g.add_rel("MADE", "Person", "Tool", spark.createDataFrame([(*e, i) for i, e in enumerate(MADE)], "_src long, _dst long, _eid long"))
    return db.connect()


def multigraph(spark, seed, nodes=7, edges=14):
    """A random multigraph with loops and parallel edges: (connection, [(eid, a, b, w)])."""
    r = random.Random(seed)
    rows = [(i, r.randrange(nodes), r.randrange(nodes), r.randrange(1, 6)) for i in range(edges)]
    db = GraphDatabase(spark)
    db.graph.add_node("V", "id", spark.createDataFrame([(i, i % 3) for i in range(nodes)], "id long, k int"))
    db.graph.add_rel("E", "V", "V", spark.createDataFrame([(a, b, w, e) for e, a, b, w in rows], "_src long, _dst long, w int, _eid long"))
    return db.connect(), rows


def walks(edges, start, lo, hi, mode="WALK", both=False):
    """All paths as (node list, edge id list) by depth-first search."""
    out = []

    def go(nodes, used):
        if lo <= len(used) <= hi:
            out.append((tuple(nodes), tuple(used)))
        if len(used) == hi:
            return
        for e, a, b, _ in edges:
            for x, y in ((a, b), (b, a)) if both else ((a, b),):
                if x == nodes[-1] and not (mode == "TRAIL" and e in used) and not (mode == "ACYCLIC" and y in nodes):
                    go([*nodes, y], [*used, e])

    go([start], [])
    return out
