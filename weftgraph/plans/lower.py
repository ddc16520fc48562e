"""Binds a query's syntax tree to the graph and lowers it to DataFrames.

Only what Catalyst cannot know is decided here: which tables a pattern needs at all, from which side a pattern is
expanded, how optional and existential patterns become outer, semi and anti joins, and how paths iterate. All
predicates, columns and aggregates are left to Catalyst to push, prune and split.
"""

from __future__ import annotations


from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import PropertyGraph
from ..functions import scalar
from ..functions import types as ty
from ..operators import paths as P
from ..operators.scope import BindError, NodeB, PathB, RelB, Scope, ValueB, rename_columns
from ..operators.traversal import edge_table, known_props, known_rel_props, node_table, oriented
from ..sources import files
from . import ast as A
from .parser import AGGREGATES

_ID_ONLY = frozenset("id label labels count start_node end_node length cost is_trail is_acyclic".split())


def conjuncts(e: Any) -> list:
    return [] if e is None else conjuncts(e.args[0]) + conjuncts(e.args[1]) if isinstance(e, A.Op) and e.name == "and" else [e]


def has_aggregate(e: Any) -> bool:
    return any(isinstance(x, A.Call) and x.name in AGGREGATES for x in A.walk(e) if not isinstance(x, (A.Exists, A.CountSub)))


def variables(e: Any) -> set[str]:
    return {x.name for x in A.walk(e) if isinstance(x, A.Var)}


class Uses:
    """Which properties of which variables a query reads; "*" stands for all of them."""

    def __init__(self, query: Any):
        self.of: dict[str, set[str]] = {}
        self.paths: set[str] = set()
        alias: list[tuple[str, str]] = []
        self._clause(query, alias)
        for _ in range(len(alias)):
            for a, b in alias:
                self.of.setdefault(a, set()).update(self.of.get(b, ()))
                if b in self.paths:
                    self.paths.add(a)

    def add(self, var: str, key: str) -> None:
        self.of.setdefault(var, set()).add(key)

    def _clause(self, x: Any, alias: list) -> None:
        if isinstance(x, A.Projection):
            for item in x.items:
                if isinstance(item.expr, A.Var) and not x.last:
                    alias.append((item.expr.name, item.alias or item.expr.name))
                else:
                    self._expr(item.expr)
            if x.star and x.last:
                self.add("*", "*")
            for e, _ in x.order:
                self._expr(e)
            self._expr(x.where)
        elif isinstance(x, A.Delete):
            pass
        elif isinstance(x, A.PathPattern) and x.var:
            self.paths.update(r.var for r in x.rels)
            self._clause([x.nodes, x.rels], alias)
        elif isinstance(x, (A.Var, A.Prop, A.Call, A.Op)):
            self._expr(x)
        elif isinstance(x, A.Hops):
            self._expr(x.where)
            if x.rel_var and x.where is not None:
                pass
        elif hasattr(x, "__dataclass_fields__"):
            for f in x.__dataclass_fields__:
                self._clause(getattr(x, f), alias)
        elif isinstance(x, (list, tuple)):
            for y in x:
                self._clause(y, alias)
        elif isinstance(x, dict):
            for y in x.values():
                self._clause(y, alias)

    def _expr(self, e: Any) -> None:
        if isinstance(e, A.Prop) and isinstance(e.of, A.Var):
            self.add(e.of.name, e.key)
        elif isinstance(e, A.Call):
            for a in e.args:
                if isinstance(a, A.Var) and e.name in _ID_ONLY:
                    if e.name in ("is_trail", "is_acyclic"):
                        self.paths.add(a.name)
                    continue
                self._expr(a)
            if e.name == "properties" and isinstance(e.args[0], A.Call) and isinstance(e.args[0].args[0], A.Var) and isinstance(e.args[1], A.Literal):
                self.add(e.args[0].args[0].name, f"{e.args[0].name}.{e.args[1].value}")
                self.paths.add(e.args[0].args[0].name)
        elif isinstance(e, A.Op) and e.name in ("=", "<>", "is null", "is not null"):
            for a in e.args:
                if not isinstance(a, A.Var):
                    self._expr(a)
        elif isinstance(e, A.Var):
            self.add(e.name, "*")
            self.paths.add(e.name)
        elif isinstance(e, (A.Exists, A.CountSub)):
            self._clause(e.paths, [])
            self._expr(e.where)
        elif hasattr(e, "__dataclass_fields__"):
            for f in e.__dataclass_fields__:
                self._expr(getattr(e, f))
        elif isinstance(e, (list, tuple)):
            for y in e:
                self._expr(y)

    def props(self, var: str, known: tuple[str, ...]) -> tuple[str, ...]:
        used = self.of.get(var, set()) | ({"*"} if "*" in self.of.get("*", ()) and not var.startswith("_anon") else set())
        return known if "*" in used else tuple(p for p in known if p in used)


class Lowering:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any] | None = None, functions: dict | None = None, tables: dict | None = None):
        self.graph, self.params = graph, params or {}
        self.functions, self.tables = functions or {}, tables or {}
        self.spark = graph.spark
        self.uses = None
        self.counter = 0
        #: How many shortest paths in order of length the query returns at most, where it says so.
        self.enough: int | None = None

    def fresh(self, base: str = "t") -> str:
        self.counter += 1
        return f"_{base}{self.counter}"

    # ---- queries

    def query(self, q: Any) -> DataFrame:
        """The result as a DataFrame with the names of its RETURN items."""
        if isinstance(q, A.Union):
            dfs = [self.query(p) for p in q.parts]
            if len({len(d.columns) for d in dfs}) > 1:
                raise BindError("the parts of a UNION have different numbers of columns")
            out = dfs[0]
            for d in dfs[1:]:
                out = out.union(d)
            return out if q.all else out.distinct()
        outer, self.uses = self.uses, Uses(q)
        try:
            return self.returned(self.single(q, Scope(None)))
        finally:
            self.uses = outer

    def returned(self, sc: Scope) -> DataFrame:
        """Columns by the names of the variables; nodes, relationships and paths as structs."""
        return sc.df.select(*[self.value(n, sc).alias(n) for n in sc.env])

    def single(self, q: A.Single, sc: Scope) -> Scope:
        clauses = q.clauses
        if sc.df is None and len(clauses) > 1 and isinstance(clauses[0], A.Match) and isinstance(clauses[1], A.Projection):
            if counted := self.counted(clauses[0], clauses[1]) or self.counted_without(clauses[0], clauses[1]):
                sc, clauses = self.project(counted[1], counted[0]), clauses[2:]
        if len(clauses) == 2 and sc.df is None:
            self.enough = self.limited(clauses[0], clauses[1])
        for clause in clauses:
            sc = self.clause(clause, sc)
        self.enough = None
        return sc

    def limited(self, m: Any, p: Any) -> int | None:
        """LIMIT (and SKIP) of ``MATCH (a)-[e*SHORTEST]->(b) RETURN … ORDER BY length(e) LIMIT n``, where no step after the paths drops or joins rows."""
        if not (isinstance(m, A.Match) and isinstance(p, A.Projection)) or m.optional or p.limit is None or p.distinct or len(m.paths) != 1 or len(m.paths[0].rels) != 1:
            return None
        r, far = m.paths[0].rels[0], m.paths[0].nodes[1]
        nodes = {n.var for n in m.paths[0].nodes}
        if r.hops is None or "SHORTEST" not in r.hops.mode or len(nodes) < 2 or any(has_aggregate(i.expr) for i in p.items):
            return None
        own = conjuncts(m.where)
        if far.props or any(variables(c) != {m.paths[0].nodes[0].var} for c in own) or any(isinstance(x, (A.Exists, A.CountSub)) for c in own for x in A.walk(c)):
            return None
        if p.order:
            first, down = p.order[0]
            named = {self.name_of(i): i.expr for i in p.items}
            first = named.get(first.name, first) if isinstance(first, A.Var) else first
            if down or first != A.Call("length", (A.Var(r.var),)):
                return None
        return self.constant(p.limit) + (self.constant(p.skip) if p.skip is not None else 0)

    # ---- counting without enumerating

    def counted(self, m: A.Match, p: A.Projection) -> tuple[Scope, A.Projection] | None:
        """A tree pattern of which only matches are counted, by at most one node: weights instead of matches.

        From the leaves to that node each edge table is summed up by its upper end, and the sums of a node's branches
        are multiplied. No step makes more rows than an edge table has, whatever the number of matches. None if the
        pattern is no tree, a condition spans two variables, or the projection reads more.
        """
        nodes = {n.var: n for path in m.paths for n in path.nodes}
        edges = [(path.nodes[i].var, r, path.nodes[i + 1].var) for path in m.paths for i, r in enumerate(path.rels)]
        rels = {r.var: r for _, r, _ in edges}
        if m.optional or m.hint or p.star or p.distinct or len(edges) < 2 or len(edges) != len(nodes) - 1 or len(rels) != len(edges):
            return None
        if any(r.hops or r.props or a == b for a, r, b in edges) or any(path.var for path in m.paths):
            return None
        if any(variables(e) for n in nodes.values() for _, e in n.props) or sum(len(q.nodes) for q in m.paths) - len(m.paths) != len(edges):
            return None
        own: dict[str, list] = {}
        for c in conjuncts(m.where):
            vs = variables(c)
            if len(vs) != 1 or any(isinstance(x, (A.Exists, A.CountSub)) for x in A.walk(c)) or not vs <= {*nodes, *rels}:
                return None
            own.setdefault(vs.pop(), []).append(c)
        count = A.Call("coalesce", (A.Call("sum", (A.Var("_weight"),)), A.Literal(0)))

        def rewritten(e):
            if isinstance(e, A.Call) and e.name == "count" and not e.distinct and (e.star or isinstance(e.args[0], A.Var) and e.args[0].name in {*nodes, *rels}):
                return count
            if isinstance(e, tuple):
                return tuple(rewritten(x) for x in e)
            return type(e)(**{f: rewritten(getattr(e, f)) for f in e.__dataclass_fields__}) if hasattr(e, "__dataclass_fields__") else e

        items = [A.Item(rewritten(i.expr), self.name_of(i), i.text) for i in p.items]
        order = [(rewritten(e), down) for e, down in p.order]
        read = {v for i in items for v in variables(i.expr)} | {v for e, _ in order for v in variables(e) if v not in [i.alias for i in items]}
        read -= {"_weight"}
        if not any(has_aggregate(i.expr) for i in items) or any(isinstance(x, A.Call) and x.name in AGGREGATES and x != count.args[0] for i in items for x in A.walk(i.expr)):
            return None
        if len(read) > 1 or not read <= set(nodes) or any(isinstance(x, (A.Exists, A.CountSub)) for i in items for x in A.walk(i.expr)):
            return None
        degree = {v: sum(v in (a, b) for a, _, b in edges) for v in nodes}
        root = next(iter(read)) if read else max(nodes, key=lambda v: degree[v])
        labels = self.infer_labels(m.paths, {})
        if not all(labels.values()):
            return None
        seen: set[str] = set()

        def table(v: str, keep: bool) -> tuple[DataFrame, NodeB] | None:
            """The node's rows that pass its conditions; None if all do and none of its columns is wanted."""
            b = self.node_binding(nodes[v], labels[v])
            if not keep and not own.get(v) and not nodes[v].props:  # the triplets tell the label
                return None
            sc = Scope(node_table(self.graph, labels[v], b.c, b.props), {v: b})
            sc = self.prop_filter(nodes[v], sc)
            for c in own.get(v, []):
                sc = Scope(sc.df.where(self.ex(c, sc)), sc.env)
            return sc.df, b

        def branches(v: str) -> list[DataFrame] | None:
            """(k, l, w) for each edge away from the root: how many matches hang below each node."""
            seen.add(v)
            out = []
            for a, r, b in edges:
                if v not in (a, b) or (below := b if a == v else a) in seen:
                    continue
                direction = r.direction if a == v else {"out": "in", "in": "out", "both": "both"}[r.direction]
                chosen = oriented(self.graph.triplets(r.types), labels[v], labels[below], direction)
                c = self.fresh(r.var)
                known = known_rel_props([t for t, _ in chosen])
                wanted = self.uses.props(r.var, known) if r.var in own else ()
                e = edge_table(self.graph, chosen, c, wanted, r.var in own)
                types = tuple(dict.fromkeys(t.type for t, _ in chosen))
                for cond in own.get(r.var, []):
                    e = e.where(self.ex(cond, Scope(e, {r.var: RelB(c, types, (), wanted, known)})))
                e = e.select(F.col(f"{c}__f").alias("k"), F.col(f"{c}__fl").alias("l"), F.col(f"{c}__t").alias("t"), F.col(f"{c}__tl").alias("tl"))
                lower = weights(below)
                if lower is not None:
                    lower = lower.select(F.col("k").alias("t"), F.col("l").alias("tl"), "w")
                    e = e.join(lower, ["t", "tl"] if len(labels[below]) > 1 else ["t"]).select("k", e["l"], "w") if len(labels[below]) > 1 else e.join(lower.drop("tl"), "t").select("k", "l", "w")
                else:
                    e = e.select("k", "l", F.lit(1).cast("long").alias("w"))
                if any(t.fans_out(fwd) for t, fwd in chosen) or len(chosen) > 1:
                    e = e.groupBy("k", "l").agg(F.sum("w").alias("w"))
                out.append(e)
            return out

        def joined(df: DataFrame, v: str, parts: list[DataFrame], id_: str, label: str, w: Column) -> tuple[DataFrame, Column]:
            for i, part in enumerate(parts):
                k, l, name = self.fresh("k"), self.fresh("l"), self.fresh("w")
                part = part.toDF(k, l, name)
                on = df[id_] == part[k]
                if len(labels[v]) > 1:
                    on = on & (df[label] == part[l])
                df, w = df.join(part, on).drop(k, l), F.col(name) if w is None else w * F.col(name)
            return df, w

        def weights(v: str) -> DataFrame | None:
            parts = branches(v)
            mine = table(v, False)
            if mine is None and not parts:
                return None
            if mine is None:
                first = parts[0].toDF("k", "l", "w0")
                df, w = joined(first, v, parts[1:], "k", "l", F.col("w0"))
                return df.select("k", "l", w.alias("w"))
            df, b = mine
            df, w = joined(df, v, parts, f"{b.c}__id", f"{b.c}__label", None)
            return df.select(F.col(f"{b.c}__id").alias("k"), F.col(f"{b.c}__label").alias("l"), (F.lit(1).cast("long") if w is None else w).alias("w"))

        parts = branches(root)
        mine = table(root, bool(read))
        env: dict = {"_weight": ValueB("_weight")}
        if mine is None:
            df, w = joined(parts[0].toDF("k", "l", "w0"), root, parts[1:], "k", "l", F.col("w0"))
        else:
            env[root] = mine[1]
            df, w = joined(mine[0], root, parts, f"{mine[1].c}__id", f"{mine[1].c}__label", None)
        kept = env[root].columns() if root in env else []
        return Scope(df.select(*kept, w.alias("_weight")), env), replace(p, items=items, order=order)

    def counted_without(self, m: A.Match, p: A.Projection) -> tuple[Scope, A.Projection] | None:
        """Matches of a tree pattern that lack an edge between two of its nodes, where only their number is read.

        They are all matches, counted by weights, less those that have the edge. These are found from the distinct pairs
        that it joins, so the pairs that lack it, which are most, are never listed.
        """
        nodes = {n.var for path in m.paths for n in path.nodes}
        lacking = [c for c in conjuncts(m.where) if isinstance(c, A.Op) and c.name == "not" and isinstance(c.args[0], A.Exists)]
        if m.optional or len(lacking) != 1 or any(variables(e) for i in p.items for e in [i.expr]) or p.order or p.distinct or p.star:
            return None
        x = lacking[0].args[0]
        if x.where is not None or len(x.paths) != 1 or len(x.paths[0].rels) != 1 or x.paths[0].rels[0].hops or x.paths[0].rels[0].props or any(n.props for n in x.paths[0].nodes):
            return None
        ends = [n.var for n in x.paths[0].nodes]
        if len(set(ends)) != 2 or not set(ends) <= nodes or x.paths[0].rels[0].var in {r.var for path in m.paths for r in path.rels}:
            return None
        rest = [c for c in conjuncts(m.where) if c is not lacking[0]]
        where = rest[0] if rest else None
        for c in rest[1:]:
            where = A.Op("and", (where, c))
        whole = replace(m, where=where)
        if not (everything := self.counted(whole, p)):
            return None
        labels = self.infer_labels([*m.paths, *x.paths], {})
        known = {v: labels[v] for v in ends}
        if not all(labels.values()):
            return everything
        edge = A.Match([replace(x.paths[0], nodes=tuple(replace(n, labels=known[n.var]) for n in x.paths[0].nodes))])
        pairs = self.match(edge, Scope(None))
        own = {v: replace(pairs.env[v], props=()) for v in ends}
        kept = [f"{b.c}__{part}" for b in own.values() for part in ("id", "label")]
        having = self.match(whole, Scope(pairs.df.select(*kept).distinct(), own))
        all_ = everything[0].df.select("_weight").unionByName(having.df.select(F.lit(-1).cast("long").alias("_weight")))
        return Scope(all_, {"_weight": ValueB("_weight")}), everything[1]

    def clause(self, c: Any, sc: Scope) -> Scope:
        if isinstance(c, A.Match):
            return self.optional(c, sc) if c.optional else self.match(c, sc)
        if isinstance(c, A.Projection):
            return self.project(c, sc)
        if isinstance(c, A.Unwind):
            sc = self.started(sc)
            e, t = self.typed(c.expr, sc)
            if isinstance(t, T.StructType):  # a list of mixed types
                e = F.array(*[e[f.name].cast("string") for f in t.fields])
            elif not isinstance(t, T.ArrayType):
                e = F.array(e)
            name = self.fresh(c.alias)
            return Scope(sc.df.select("*", F.explode(e).alias(name)), sc.env | {c.alias: ValueB(name)})
        if isinstance(c, A.LoadFrom):
            return self.load_from(c, sc)
        if isinstance(c, A.CallSubquery):
            return self.call_subquery(c, sc)
        if isinstance(c, A.CallFunction):
            return self.call_function(c, sc)
        raise BindError(f"{type(c).__name__} cannot stand in a query that returns rows")

    def started(self, sc: Scope) -> Scope:
        return sc if sc.df is not None else Scope(self.spark.range(1).select(), sc.env)

    # ---- patterns

    def labels(self, n: A.NodePattern) -> tuple[str, ...]:
        for label in n.labels:
            self.graph.node(label)
        return tuple(n.labels) or tuple(self.graph.nodes)

    def infer_labels(self, paths: list[A.PathPattern], env: dict) -> dict[str, tuple[str, ...]]:
        """The labels that each node variable can have, narrowed by the triplets around it until nothing changes."""
        found: dict[str, tuple[str, ...]] = {}
        for p in paths:
            for n in p.nodes:
                own = env[n.var].labels if isinstance(env.get(n.var), NodeB) else self.labels(n)
                if n.var in env and n.labels:
                    own = tuple(x for x in own if x in n.labels)
                found[n.var] = tuple(x for x in found.get(n.var, own) if x in own)
        changed = True
        while changed:
            changed = False
            for p in paths:
                for left, r, right in zip(p.nodes, p.rels, p.nodes[1:], strict=False):
                    if r.hops is not None:
                        self.graph.triplets(r.types)
                        continue
                    chosen = oriented(self.graph.triplets(r.types), found[left.var], found[right.var], r.direction)
                    for v, ok in (
                        (left.var, {t.src if fwd else t.dst for t, fwd in chosen}),
                        (right.var, {t.dst if fwd else t.src for t, fwd in chosen}),
                    ):
                        narrowed = tuple(x for x in found[v] if x in ok)
                        if narrowed != found[v]:
                            found[v], changed = narrowed, True
        return found

    def match(self, m: A.Match, sc: Scope) -> Scope:
        """Expands one edge at a time: first edges between bound nodes, then from bound nodes on, else from a new start."""
        labels = self.infer_labels(m.paths, sc.env)
        fixed = self.selective(m)
        edges = [(p.nodes[i], r, p.nodes[i + 1]) for p in m.paths for i, r in enumerate(p.rels)]
        lone = [n for p in m.paths for n in p.nodes]
        hinted = {v: i for i, v in enumerate(m.hint or ())}
        checked: set[str] = set()
        waiting = conjuncts(m.where)
        while True:
            for n in lone:  # property maps and labels of nodes that earlier clauses bound
                if n.var in sc.env and n.var not in checked:
                    checked.add(n.var)
                    sc = self.bound_node(n, sc)
            if not edges:
                break
            def rank(e):
                left, r, right = e
                both = (left.var in sc.env) + (right.var in sc.env)
                away = left if left.var not in sc.env else right
                fan = r.hops is not None or any(t.fans_out(fwd == (left.var in sc.env)) for t, fwd in oriented(self.graph.triplets(r.types), labels[left.var], labels[right.var], r.direction))
                near = right.var if away is left else left.var
                spread = self.spread(r, labels[near]) if fan and r.hops is None else 0.0
                return (-both, r.hops is not None, min(hinted.get(r.var, 999), hinted.get(away.var, 999)), away.var not in fixed, fan, spread)

            best = min(edges, key=rank)
            left, r, right = best
            if left.var not in sc.env and right.var not in sc.env:
                nodes = [n for e in edges for n in (e[0], e[2])]
                start = min(nodes, key=lambda n: (hinted.get(n.var, 999), fixed.get(n.var, 9)))
                near = [e for e in edges if start.var in (e[0].var, e[2].var) and e[0].var != e[2].var and e[1].hops is None]
                if sc.df is None and near and not hinted:
                    first = min(near, key=rank)
                    if begun := self.from_edge(*first, labels):
                        edges.remove(first)
                        sc = begun
                        continue
                sc = self.scan(start, labels[start.var], sc)
                continue
            edges.remove(best)
            if r.hops is not None:  # paths are built level by level from rows that are already narrowed
                ready = [c for c in waiting if variables(c) <= set(sc.env) and not any(isinstance(x, (A.Exists, A.CountSub)) for x in A.walk(c))]
                waiting = [c for c in waiting if c not in ready]
                for c in ready:
                    sc = self.where(c, sc)
            sc = self.expand(left, r, right, labels, sc)
        for n in lone:
            if n.var not in sc.env:
                sc = self.scan(n, labels[n.var], sc)
        for p in m.paths:
            if p.var:
                sc = self.name_path(p, sc)
        for c in waiting:
            sc = self.where(c, sc)
        return sc

    def spread(self, r: A.RelPattern, labels: tuple[str, ...]) -> float:
        """How many edges a node has on average, by the planner's estimates of the tables' sizes; no job runs for it."""
        edges = sum(_size(t.df) for t in self.graph.triplets(r.types) if t.src in labels or t.dst in labels)
        return edges / max(1.0, sum(_size(self.graph.nodes[x].df) for x in labels))

    def selective(self, m: A.Match) -> dict[str, int]:
        """How selective the predicates on a variable look: 0 its key, 1 an equality, 2 another comparison."""
        out: dict[str, int] = {}
        nodes = {n.var: n for p in m.paths for n in p.nodes}

        def note(var, key, rank):
            n = nodes.get(var)
            if n is not None:
                is_key = any(self.graph.nodes[x].key == key for x in n.labels if x in self.graph.nodes)
                out[var] = min(out.get(var, 9), 0 if rank == 1 and is_key else rank)

        for n in nodes.values():
            for key, _ in n.props:
                note(n.var, key, 1)
        for c in conjuncts(m.where):
            if isinstance(c, A.Op) and c.name in ("=", "in", "<", "<=", ">", ">="):
                for a, b in (c.args, c.args[::-1]):
                    if isinstance(a, A.Prop) and isinstance(a.of, A.Var) and not variables(b):
                        note(a.of.name, a.key, 1 if c.name in ("=", "in") else 2)
        return out

    def node_binding(self, n: A.NodePattern, labels: tuple[str, ...]) -> NodeB:
        known = known_props(self.graph, labels)
        wanted = {k for k, _ in n.props} | set(self.uses.props(n.var, known))
        for k, _ in n.props:
            if k not in known:
                raise BindError(f"{'|'.join(labels)} has no property {k}")
        return NodeB(self.fresh(n.var), labels, tuple(p for p in known if p in wanted), known)

    def prop_filter(self, pattern: Any, sc: Scope) -> Scope:
        for key, e in pattern.props:
            sc = Scope(sc.df.where(self.ex(A.Prop(A.Var(pattern.var), key), sc) == self.ex(e, sc)), sc.env)
        return sc

    def scan(self, n: A.NodePattern, labels: tuple[str, ...], sc: Scope) -> Scope:
        if not labels:
            labels = self.labels(n)
            b = self.node_binding(n, labels)
            df = node_table(self.graph, labels, b.c, b.props).limit(0)
        else:
            b = self.node_binding(n, labels)
            df = node_table(self.graph, labels, b.c, b.props)
        df = df if sc.df is None else sc.df.crossJoin(df)
        return self.prop_filter(n, Scope(df, sc.env | {n.var: b}))

    def bound_node(self, n: A.NodePattern, sc: Scope) -> Scope:
        b = sc.env[n.var]
        if not isinstance(b, NodeB):
            raise BindError(f"{n.var} is no node")
        if n.labels and not set(b.labels) <= set(n.labels):
            sc = Scope(sc.df.where(F.col(f"{b.c}__label").isin(*n.labels)), sc.env)
        missing = [k for k, _ in n.props if k not in b.props]
        if missing:
            sc = self.load_props(n.var, tuple(missing), sc)
        return self.prop_filter(n, sc)

    def load_props(self, var: str, props: tuple[str, ...], sc: Scope) -> Scope:
        """Joins further properties of a bound node."""
        b = sc.env[var]
        more = tuple(p for p in props if p in b.known and p not in b.props)
        if not more:
            return sc
        t = self.fresh("v")
        right = node_table(self.graph, b.labels, t, more)
        on = (sc.df[f"{b.c}__id"] == right[f"{t}__id"]) & (sc.df[f"{b.c}__label"] == right[f"{t}__label"])
        df = sc.df.join(right, on, "left").withColumnsRenamed({f"{t}__p_{p}": f"{b.c}__p_{p}" for p in more}).drop(f"{t}__id", f"{t}__label")
        return Scope(df, sc.env | {var: replace(b, props=b.props + more)})

    def expand(self, left: A.NodePattern, r: A.RelPattern, right: A.NodePattern, labels: dict, sc: Scope) -> Scope:
        """Joins the edges of ``r``, from whichever end is bound."""
        direction, turned = r.direction, left.var not in sc.env
        if turned:
            left, right = right, left
            direction = {"out": "in", "in": "out", "both": "both"}[direction]
        if r.hops is not None:
            out = self.expand_path(left, r, right, direction, labels, sc)
            b = out.env.get(r.var)
            if turned and isinstance(b, PathB) and b.full:  # in the order of the pattern
                out = Scope(out.df.withColumns({f"{b.c}__{x}": F.reverse(f"{b.c}__{x}") for x in ("nodes", "rels")}), out.env)
            return out
        a = sc.env[left.var]
        if r.var in sc.env:
            return self.rebound(left, r, right, direction, labels, sc)
        triplets = self.graph.triplets(r.types)
        chosen = oriented(triplets, labels[left.var], labels[right.var], direction)
        c = self.fresh(r.var)
        if not chosen:
            return self.nothing(left, r, right, c, triplets, labels, sc)
        known = known_rel_props([t for t, _ in chosen])
        wanted = {k for k, _ in r.props} | set(self.uses.props(r.var, known))
        props = tuple(p for p in known if p in wanted)
        for k in wanted:
            if k not in known:
                raise BindError(f"{'|'.join(r.types)} has no property {k}")
        types = tuple(dict.fromkeys(t.type for t, _ in chosen))
        edges = edge_table(self.graph, chosen, c, props, r.named)
        for k, e in r.props:
            if not variables(e):
                edges = edges.where(F.col(f"{c}__p_{k}") == self.ex(e, Scope(None)))
        from_labels = {t.src if fwd else t.dst for t, fwd in chosen}
        on = sc.df[f"{a.c}__id"] == edges[f"{c}__f"]
        if len(a.labels) > 1 or len(from_labels) > 1:
            on = on & (sc.df[f"{a.c}__label"] == edges[f"{c}__fl"])
        env = dict(sc.env)
        if right.var in env:
            b = env[right.var]
            on = on & (sc.df[f"{b.c}__id"] == edges[f"{c}__t"])
            if len(b.labels) > 1 or len({t.dst if fwd else t.src for t, fwd in chosen}) > 1:
                on = on & (sc.df[f"{b.c}__label"] == edges[f"{c}__tl"])
            df = sc.df.join(edges, on).drop(f"{c}__f", f"{c}__fl", f"{c}__t", f"{c}__tl")
        else:
            df = sc.df.join(edges, on).drop(f"{c}__f", f"{c}__fl")
            df, env[right.var] = self.arrive(right, df, f"{c}__t", f"{c}__tl", tuple(x for x in labels[right.var]))
        for k, e in r.props:
            if variables(e):
                df = df.where(F.col(f"{c}__p_{k}") == self.ex(e, sc))
        if r.named:
            ends = tuple(dict.fromkeys((t.src, t.dst) for t, _ in chosen))
            env[r.var] = RelB(c, types, ends, props, known)
        out = Scope(df, env)
        return self.prop_filter(right, out) if right.var not in sc.env else out

    def from_edge(self, left: A.NodePattern, r: A.RelPattern, right: A.NodePattern, labels: dict) -> Scope | None:
        """A start from an edge table, so that a node table is read only if more than its key is."""
        chosen = oriented(self.graph.triplets(r.types), labels[left.var], labels[right.var], r.direction)
        if not chosen or any(variables(e) for _, e in r.props):
            return None
        c, known = self.fresh(r.var), known_rel_props([t for t, _ in chosen])
        wanted = {k for k, _ in r.props} | set(self.uses.props(r.var, known))
        if not wanted <= set(known):
            return None
        props = tuple(p for p in known if p in wanted)
        df = edge_table(self.graph, chosen, c, props, r.named)
        for k, e in r.props:
            df = df.where(F.col(f"{c}__p_{k}") == self.ex(e, Scope(None)))
        env: dict = {}
        df, env[left.var] = self.arrive(left, df, f"{c}__f", f"{c}__fl", labels[left.var])
        df, env[right.var] = self.arrive(right, df, f"{c}__t", f"{c}__tl", labels[right.var])
        if r.named:
            env[r.var] = RelB(c, tuple(dict.fromkeys(t.type for t, _ in chosen)), tuple(dict.fromkeys((t.src, t.dst) for t, _ in chosen)), props, known)
        return Scope(df, env)

    def arrive(self, n: A.NodePattern, df: DataFrame, id_: str, label: str, labels: tuple[str, ...]) -> tuple[DataFrame, NodeB]:
        """Binds an edge's end: a join with the node tables only if more than the key is read of it."""
        b = self.node_binding(n, labels)
        if not b.props:
            return df.withColumnsRenamed({id_: f"{b.c}__id", label: f"{b.c}__label"}), b
        if len(labels) == 1 and b.props == (self.graph.nodes[labels[0]].key,):
            key = F.col(id_).cast(self.graph.key_type(labels[0]))
            return df.withColumn(f"{b.c}__p_{b.props[0]}", key).withColumnsRenamed({id_: f"{b.c}__id", label: f"{b.c}__label"}), b
        nodes = node_table(self.graph, labels, b.c, b.props)
        on = df[id_] == nodes[f"{b.c}__id"]
        if len(labels) > 1:
            on = on & (df[label] == nodes[f"{b.c}__label"])
        return df.join(nodes, on).drop(id_, label), b

    def nothing(self, left, r, right, c, triplets, labels, sc: Scope) -> Scope:
        """No triplet leads from one to the other: an empty result with all variables bound."""
        df, env = sc.df, dict(sc.env)
        if right.var not in env:
            sc2 = self.scan(replace(right, props=()), labels[right.var] or (), Scope(df.limit(0), env))
            df, env = sc2.df, sc2.env
        if r.named:
            known = known_rel_props(triplets)
            e = edge_table(self.graph, [(t, True) for t in triplets], c, known, True).drop(f"{c}__f", f"{c}__t", f"{c}__fl", f"{c}__tl").limit(0)
            df = df.crossJoin(e)
            env[r.var] = RelB(c, tuple(r.types), (), known, known)
        return Scope(df.where(F.lit(False)), env)

    def rebound(self, left, r, right, direction, labels, sc: Scope) -> Scope:
        """A relationship variable that is bound already: its ends are compared with the nodes."""
        e, a = sc.env[r.var], sc.env[left.var]
        if not isinstance(e, RelB):
            raise BindError(f"{r.var} is no relationship")
        f, t = ("src", "dst") if direction != "in" else ("dst", "src")
        fl, tl = ("slabel", "dlabel") if direction != "in" else ("dlabel", "slabel")
        df = sc.df.where((F.col(f"{e.c}__{f}") == F.col(f"{a.c}__id")) & (F.col(f"{e.c}__{fl}") == F.col(f"{a.c}__label")))
        env = dict(sc.env)
        if right.var in env:
            b = env[right.var]
            return Scope(df.where((F.col(f"{e.c}__{t}") == F.col(f"{b.c}__id")) & (F.col(f"{e.c}__{tl}") == F.col(f"{b.c}__label"))), env)
        x, y = self.fresh("i"), self.fresh("l")
        df, env[right.var] = self.arrive(right, df.withColumns({x: F.col(f"{e.c}__{t}"), y: F.col(f"{e.c}__{tl}")}), x, y, labels[right.var])
        return self.prop_filter(right, Scope(df, env))

    # ---- paths of variable length

    def path_hops(self, r: A.RelPattern, direction: str, path_props: tuple[set, set], need: bool) -> DataFrame:
        """The hop table: h_from, h_fl, h_to, h_tl, h_eid, h_ok, h_rel, h_node."""
        hops = r.hops
        triplets = self.graph.triplets(r.types)
        everyone = tuple(self.graph.nodes)
        chosen = oriented(triplets, everyone, everyone, direction)
        known = known_rel_props(triplets)
        where = conjuncts(hops.where)
        on_rel = [w for w in where if variables(w) <= {hops.rel_var}]
        on_node = [w for w in where if w not in on_rel]
        if "SHORTEST" in hops.mode and any(hops.rel_var in variables(w) for w in on_node):
            raise BindError("a shortest path's conditions must be on its relationship or on its node")

        def read(var: str | None) -> set[str]:
            return {x.key for w in where for x in A.walk(w) if isinstance(x, A.Prop) and isinstance(x.of, A.Var) and x.of.name == var}

        rel_uses = read(hops.rel_var) | {k for k, _ in r.props} | path_props[1] | ({hops.weight} if hops.weight else set())
        if "*" in rel_uses:
            rel_uses |= set(known)
        props = tuple(p for p in known if p in rel_uses)
        for p in rel_uses - {"*"}:
            if p not in known:
                raise BindError(f"{'|'.join(r.types)} has no property {p}")
        c = self.fresh("h")
        edges = edge_table(self.graph, chosen, c, props, True)
        sc = Scope(edges, {hops.rel_var or r.var: RelB(c, tuple(r.types), (), props, known)})
        for k, e in r.props:
            edges = edges.where(F.col(f"{c}__p_{k}") == self.ex(e, Scope(None)))
        for w in on_rel:
            edges = edges.where(self.ex(w, sc))
        node_known = known_props(self.graph, everyone)
        node_uses = read(hops.node_var) | path_props[0]
        if "*" in node_uses:
            node_uses |= set(node_known)
        node_props = tuple(p for p in node_known if p in node_uses)
        ok, v = F.lit(True), None
        if node_props:
            v = self.fresh("n")
            ends = tuple(dict.fromkeys(t.dst if fwd else t.src for t, fwd in chosen))
            nodes = node_table(self.graph, ends, v, node_props)
            node_props = tuple(p for p in node_props if f"{v}__p_{p}" in nodes.columns)
            edges = edges.join(nodes, (edges[f"{c}__t"] == nodes[f"{v}__id"]) & (edges[f"{c}__tl"] == nodes[f"{v}__label"]))
            nsc = Scope(edges, {**({hops.rel_var: RelB(c, tuple(r.types), (), props, known)} if hops.rel_var else {}), hops.node_var or "_": NodeB(v, ends, node_props, node_props)})
            for w in on_node:
                ok = ok & F.coalesce(self.ex(w, nsc), F.lit(False))
        node = self.path_node(F.col(f"{c}__t"), F.col(f"{c}__tl"), v, node_props)
        rel = F.struct(F.col(f"{c}__type").alias("_type"), F.col(f"{c}__eid").alias("_eid"), F.col(f"{c}__src").alias("_src"), F.col(f"{c}__slabel").alias("_slabel"), F.col(f"{c}__dst").alias("_dst"), F.col(f"{c}__dlabel").alias("_dlabel"), *[F.col(f"{c}__p_{p}").alias(p) for p in props])
        return edges.select(F.col(f"{c}__f").alias("h_from"), F.col(f"{c}__fl").alias("h_fl"), F.col(f"{c}__t").alias("h_to"), F.col(f"{c}__tl").alias("h_tl"), F.col(f"{c}__eid").alias("h_eid"), ok.alias("h_ok"), rel.alias("h_rel"), node.alias("h_node")), node_props

    @staticmethod
    def path_node(id_: Column, label: Column, v: str | None, props: tuple[str, ...]) -> Column:
        return F.struct(id_.alias("_id"), label.alias("_label"), *[F.col(f"{v}__p_{p}").alias(p) for p in props])

    def expand_path(self, left, r, right, direction, labels, sc: Scope) -> Scope:
        hops, a = r.hops, sc.env[left.var]
        lo, hi = hops.lo, P.MOST_HOPS if hops.hi is None else hops.hi
        if hi < lo or hi > P.MOST_HOPS:
            raise BindError(f"hops {lo}..{hi} are not within 0..{P.MOST_HOPS}")
        if "SHORTEST" in hops.mode and lo != 1 and "W" not in hops.mode:
            raise BindError("a shortest path starts at one hop")
        used = self.uses.of.get(r.var, set()) | self.uses.of.get("*", set())
        node_used = {u[6:] for u in used if u.startswith("nodes.")} | (set(hops.nodes_kept or ()) if hops.nodes_kept is not None else {"*"} & used)
        rel_used = {u[5:] for u in used if u.startswith("rels.")} | {u[14:] for u in used if u.startswith("relationships.")} | (set(hops.rels_kept or ()) if hops.rels_kept is not None else {"*"} & used)
        full = r.named and (r.var in self.uses.paths or bool(used)) or hops.mode in ("TRAIL", "ACYCLIC")
        table, node_props = self.path_hops(r, direction, (node_used, rel_used), full)
        c, root_props = self.fresh(r.var), ()
        if full and node_props:
            root_props = tuple(p for p in node_props if p in a.known)
            sc = self.load_props(left.var, root_props, sc)
            a = sc.env[left.var]
        types = table.schema["h_node"].dataType
        root = F.struct(F.col(f"{a.c}__id").alias("_id"), F.col(f"{a.c}__label").alias("_label"), *[(F.col(f"{a.c}__p_{p}") if p in a.known else F.lit(None)).cast(types[p].dataType).alias(p) for p in node_props])
        weighted = hops.weight is not None
        if "SHORTEST" in hops.mode:
            every = hops.mode.startswith("ALL")
            ri, rl = self.fresh("ri"), self.fresh("rl")
            rooted = [F.col(f"{a.c}__id").alias("root"), F.col(f"{a.c}__label").alias("rootl"), *([root.alias("node")] if full else [])]
            b = sc.env.get(right.var)
            if isinstance(b, NodeB) and not weighted:
                pairs = P.written(sc.df.select(*rooted, F.col(f"{b.c}__id").alias("end"), F.col(f"{b.c}__label").alias("el")).dropDuplicates(["root", "rootl", "end", "el"]))
                found = P.shortest_between(pairs, table, hi, every, full)
            else:
                roots = P.written(sc.df.select(*rooted).dropDuplicates(["root", "rootl"]))
                if weighted:
                    found = P.cheapest(roots, table, lo, hi, hops.weight, every, full)
                else:
                    ends = labels[right.var]
                    found = P.shortest(roots, table, lo, hi, every, full, self.enough, None if set(ends) == set(self.graph.nodes) else ends)
            columns = {"root": ri, "rootl": rl, "end": f"{c}__end", "el": f"{c}__el", "len": f"{c}__len", "cost": f"{c}__cost", "nodes": f"{c}__nodes", "rels": f"{c}__rels"}
            found = found.select(*[F.col(x).alias(y) for x, y in columns.items() if x in found.columns])
            df = sc.df.join(found, (sc.df[f"{a.c}__id"] == found[ri]) & (sc.df[f"{a.c}__label"] == found[rl])).drop(ri, rl)
        else:
            front = {f"{c}__end": F.col(f"{a.c}__id"), f"{c}__el": F.col(f"{a.c}__label"), f"{c}__len": F.lit(0), f"{c}__ok": F.lit(True)}
            if full:
                front |= {f"{c}__nodes": F.array(root.cast(types)), f"{c}__rels": F.array().cast(T.ArrayType(table.schema["h_rel"].dataType))}
            df = P.walk(sc.df.withColumns(front), table, c, lo, hi, hops.mode, full).drop(f"{c}__ok")
        env = dict(sc.env)
        if r.named:
            env[r.var] = PathB(c, full, weighted)
        if right.var in env:
            b = env[right.var]
            df = df.where((F.col(f"{c}__end") == F.col(f"{b.c}__id")) & (F.col(f"{c}__el") == F.col(f"{b.c}__label"))).drop(f"{c}__end", f"{c}__el")
            return Scope(df, env)
        ends = labels[right.var]
        if set(ends) != set(self.graph.nodes):
            df = df.where(F.col(f"{c}__el").isin(*ends))
        df, env[right.var] = self.arrive(right, df, f"{c}__end", f"{c}__el", ends)
        return self.prop_filter(right, Scope(df, env))

    def name_path(self, p: A.PathPattern, sc: Scope) -> Scope:
        """p = (a)-[e]->(b)…: keys, labels and edges of the parts as one path; a part of variable length gives all of its own."""
        c = self.fresh(p.var)
        node = ("_id", "_label")
        rel = ("type", "eid", "src", "slabel", "dst", "dlabel")
        first = sc.env[p.nodes[0].var]
        nodes = [F.array(F.struct(*[F.col(f"{first.c}_{x}").alias(x) for x in node]))]
        rels, length = [F.array().cast("array<struct<_type:string,_eid:bigint,_src:{0},_slabel:string,_dst:{0},_dlabel:string>>".format("string" if self.graph.text_ids else "bigint"))], F.lit(0)
        for r, n in zip(p.rels, p.nodes[1:], strict=True):
            b = sc.env.get(r.var)
            if isinstance(b, RelB):
                far = sc.env[n.var]
                nodes.append(F.array(F.struct(*[F.col(f"{far.c}_{x}").alias(x) for x in node])))
                rels.append(F.array(F.struct(*[F.col(f"{b.c}__{x}").alias(f"_{x}") for x in rel])))
                length = length + 1
            elif isinstance(b, PathB) and b.full:
                own = F.transform(f"{b.c}__nodes", lambda v: F.struct(*[v[x].alias(x) for x in node]))
                mine = F.transform(f"{b.c}__rels", lambda e: F.struct(*[e[f"_{x}"].alias(f"_{x}") for x in rel]))
                nodes.append(F.slice(own, F.lit(2), F.size(own)))
                rels.append(mine)
                length = length + F.col(f"{b.c}__len")
            else:
                raise BindError("the relationships of a named path must be named")
        df = sc.df.withColumns({f"{c}__nodes": F.concat(*nodes), f"{c}__rels": F.concat(*rels), f"{c}__len": length})
        return Scope(df, sc.env | {p.var: PathB(c)})

    # ---- predicates with patterns

    def where(self, e: Any, sc: Scope) -> Scope:
        """Filters; top-level [NOT] EXISTS conjuncts become semi and anti joins, others a mark that is joined in."""
        for c in conjuncts(e):
            inner = c.args[0] if isinstance(c, A.Op) and c.name == "not" else c
            if isinstance(inner, A.Exists):
                sc = self.exists(inner, sc, "left_anti" if inner is not c else "left_semi")
            else:
                sc, c = self.marked(c, sc)
                sc = Scope(sc.df.where(self.ex(c, sc)), sc.env)
        return sc

    def marked(self, e: Any, sc: Scope) -> tuple[Scope, Any]:
        """Replaces nested EXISTS and COUNT patterns by columns joined to the rows."""
        for x in [x for x in A.walk(e) if isinstance(x, (A.Exists, A.CountSub))]:
            name = self.fresh("mark")
            right, keys = self.correlated(x, sc)
            agg = right.groupBy(*[k for _, k in keys]).agg(F.count(F.lit(1)).alias(name))
            on = [sc.df[a].eqNullSafe(agg[b]) for a, b in keys]
            # without keys the pattern is the same for all rows: one count meets them
            df = sc.df.join(agg, on, "left").drop(*[b for _, b in keys]) if keys else sc.df.crossJoin(agg)
            value = F.coalesce(name, F.lit(0).cast("long"))
            df = df.withColumn(name, value > 0 if isinstance(x, A.Exists) else value)
            sc = Scope(df, sc.env | {name: ValueB(name)})
            e = _replaced(e, x, A.Var(name))
        return sc, e

    def exists(self, x: A.Exists, sc: Scope, how: str) -> Scope:
        right, keys = self.correlated(x, sc)
        on = [sc.df[a] == right[b] for a, b in keys]
        return Scope(sc.df.join(right, on, how) if keys else sc.df.join(right.limit(1), F.lit(True), how), sc.env)

    def correlated(self, x: Any, sc: Scope) -> tuple[DataFrame, list[tuple[str, str]]]:
        """The rows of a sub-pattern, and pairs of equal columns (outer, inner).

        If the pattern shares only nodes with the outer rows it is built on its own from scans. Else it starts from
        the distinct values of the outer columns that it reads.
        """
        m = A.Match(list(x.paths), x.where)
        pattern_vars = {n.var for p in x.paths for n in p.nodes} | {r.var for p in x.paths for r in p.rels}
        shared = [v for v in dict.fromkeys([*pattern_vars, *sorted(variables(x.where) | variables(x.paths))]) if v in sc.env]
        if not shared:
            return self.match(m, Scope(None)).df.select(F.lit(1).alias(self.fresh("one"))), []
        if all(isinstance(sc.env[v], NodeB) and v in pattern_vars for v in shared):
            inner = self.match(replace_labels(m, sc, shared), Scope(None))
            keys = []
            columns = []
            for v in shared:
                b, o = inner.env[v], sc.env[v]
                for part in ("id", "label") if len(o.labels) > 1 or len(b.labels) > 1 else ("id",):
                    k = self.fresh("k")
                    columns.append(F.col(f"{b.c}__{part}").alias(k))
                    keys.append((f"{o.c}__{part}", k))
            return inner.df.select(*columns), keys
        columns, keys, env = [], [], {}
        for v in shared:
            to = self.fresh(v)
            own, env[v] = rename_columns(sc.df, sc.env[v], to)
            columns += own
            keys += list(zip(sc.env[v].columns(), env[v].columns(), strict=True))
        inner = self.match(m, Scope(sc.df.select(*columns).distinct(), env))
        return inner.df.select(*[b for _, b in keys]), keys

    def optional(self, m: A.Match, sc: Scope) -> Scope:
        """OPTIONAL MATCH: the pattern with its WHERE is built apart and left-joined on what it shares."""
        if sc.df is None:
            raise BindError("a query cannot start with OPTIONAL MATCH")
        pattern_vars = list(dict.fromkeys([n.var for p in m.paths for n in p.nodes] + [r.var for p in m.paths for r in p.rels]))
        shared = [v for v in dict.fromkeys([*pattern_vars, *sorted(variables(m.where) | variables(m.paths))]) if v in sc.env]
        alone = bool(shared) and all(isinstance(sc.env[v], NodeB) and v in pattern_vars for v in shared)
        keys, env = [], {}
        if alone:
            inner = self.match(replace_labels(m, sc, shared), Scope(None))
        else:
            columns = []
            for v in shared:
                own, env[v] = rename_columns(sc.df, sc.env[v], self.fresh(v))
                columns += own
            start = Scope(sc.df.select(*columns).distinct(), env) if columns else Scope(None)
            inner = self.match(m, start)
        new = {v: b for v, b in inner.env.items() if v not in sc.env}
        columns = [c for b in new.values() for c in b.columns()]
        if alone:
            for v in shared:
                b, o = inner.env[v], sc.env[v]
                for part in ("id", "label") if len(o.labels) > 1 or len(b.labels) > 1 else ("id",):
                    keys.append((f"{o.c}__{part}", f"{b.c}__{part}"))
        else:
            keys = [k for v in shared for k in zip(sc.env[v].columns(), inner.env[v].columns(), strict=True)]
        right = inner.df.select(*dict.fromkeys([*columns, *[k for _, k in keys]]))
        if not keys:
            df = sc.df.join(right, F.lit(True), "left")
        else:
            df = sc.df.join(right, [sc.df[a] == right[b] if alone else sc.df[a].eqNullSafe(right[b]) for a, b in keys], "left").drop(*[b for _, b in keys])
        return Scope(df, sc.env | new)

    # ---- projections

    def name_of(self, item: A.Item) -> str:
        return item.alias or item.text

    def project(self, p: A.Projection, sc: Scope) -> Scope:
        sc = self.started(sc)
        items: list[A.Item] = []
        if p.star:
            items += [A.Item(A.Var(v), v) for v in sc.env if not v.startswith("_anon") and not v.startswith("_mark")]
        for i in p.items:
            if isinstance(i.expr, A.Prop) and i.expr.key == "*":
                b = sc.env.get(i.expr.of.name)
                if not isinstance(b, (NodeB, RelB)):
                    raise BindError(f"{i.expr.of.name} has no properties")
                items += [A.Item(A.Prop(i.expr.of, k), f"{i.expr.of.name}.{k}") for k in b.known]
            else:
                items.append(i)
        names = [self.name_of(i) for i in items]
        if len(set(names)) < len(names):
            raise BindError(f"two columns have the name {next(n for n in names if names.count(n) > 1)}")
        for i, item in enumerate(items):
            if any(isinstance(x, (A.Exists, A.CountSub)) for x in A.walk(item.expr)):
                sc, e = self.marked(item.expr, sc)
                items[i] = A.Item(e, names[i])
        grouped = any(has_aggregate(i.expr) for i in items)
        order = [(self._as_output(e, items, names), down) for e, down in p.order]
        if grouped:
            out = self.aggregate(items, names, sc)
        else:
            out = self.plain(items, names, sc, [] if p.distinct else [e for e, _ in order])
        if p.distinct:
            out = Scope(out.df.select(*out.columns()).distinct(), out.env)
        if order:
            keys = []
            for e, down in order:
                if isinstance(e, A.Var) and e.name in out.env or grouped or p.distinct:
                    k = self.sort_key(e, out)
                else:
                    k = self.sort_key(e, Scope(out.df, {v: b for v, b in sc.env.items() if v not in out.env} | out.env))
                keys.append(k.desc_nulls_last() if down else k.asc_nulls_first())
            out = Scope(out.df.orderBy(*keys), out.env)
        df = out.df
        if p.skip is not None:
            df = df.offset(self.constant(p.skip))
        if p.limit is not None:
            df = df.limit(self.constant(p.limit))
        out = Scope(df.select(*out.columns()), out.env)
        return self.where(p.where, out) if p.where is not None else out

    def sort_key(self, e: Any, sc: Scope) -> Column:
        if isinstance(e, A.Var) and isinstance(sc.env.get(e.name), NodeB):
            return F.col(f"{sc.env[e.name].c}__id")
        key = self.ex(e, sc)
        kind = self.type_of(key, sc)
        return scalar.interval_order(key, kind) if isinstance(kind, T.CalendarIntervalType) else key

    def _as_output(self, e: Any, items: list, names: list) -> Any:
        """A sort expression in terms of the output columns where it, or a part of it, is one of the items."""
        for i, n in zip(items, names, strict=True):
            if e == i.expr:
                return A.Var(n)
        if isinstance(e, A.Var):
            return e
        if isinstance(e, (A.Op, A.Call)):
            return replace(e, args=tuple(self._as_output(a, items, names) for a in e.args))
        return e

    def constant(self, e: Any) -> int:
        if isinstance(e, A.Literal) and isinstance(e.value, int):
            n = e.value
        else:
            if variables(e):
                raise BindError("SKIP and LIMIT need a constant")
            n = self.spark.range(1).select(self.ex(e, Scope(None)).cast("int").alias("n")).first()["n"]
        if n is None or n < 0:
            raise BindError("SKIP and LIMIT need a whole number from 0")
        return n

    def plain(self, items: list, names: list, sc: Scope, order: list) -> Scope:
        """Non-aggregating items; further columns that ORDER BY reads are kept until the sort."""
        columns: list[Column] = []
        env: dict = {}
        kept: set[str] = set()
        for item, name in zip(items, names, strict=True):
            if isinstance(item.expr, A.Var) and isinstance(sc.env.get(item.expr.name), (NodeB, RelB, PathB)):
                b = sc.env[item.expr.name]
                if b.c in kept:
                    own, b = rename_columns(sc.df, b, self.fresh(name))
                    columns += own
                else:
                    kept.add(b.c)
                    columns += [F.col(f"`{x}`") for x in b.columns()]
                env[name] = b
            else:
                c = self.fresh("c")
                columns.append(self.ex(item.expr, sc).alias(c))
                env[name] = ValueB(c)
        extra = [x for e in order for v in variables(e) if v in sc.env and v not in names for x in sc.env[v].columns()]
        have = {x for b in env.values() for x in b.columns()}
        columns += [F.col(f"`{x}`") for x in dict.fromkeys(extra) if x not in have]
        return Scope(sc.df.select(*columns), env)

    def aggregate(self, items: list, names: list, sc: Scope) -> Scope:
        """Groups by the items without aggregates. A node as a key groups by its id alone; its properties depend on it."""
        keys: list[Column] = []
        aggs: list[Column] = []
        env: dict = {}
        later: list[tuple[str, Any]] = []
        for item, name in zip(items, names, strict=True):
            if has_aggregate(item.expr):
                later.append((name, item.expr))
                env[name] = None
                continue
            if isinstance(item.expr, A.Var) and isinstance(sc.env.get(item.expr.name), NodeB):
                b = sc.env[item.expr.name]
                keys += [F.col(f"{b.c}__id"), F.col(f"{b.c}__label")]
                aggs += [F.first(f"{b.c}__p_{p}").alias(f"{b.c}__p_{p}") for p in b.props]
                env[name] = b
            elif isinstance(item.expr, A.Var) and isinstance(sc.env.get(item.expr.name), (RelB, PathB)):
                b = sc.env[item.expr.name]
                keys += [F.col(x) for x in b.columns()]
                env[name] = b
            else:
                c = self.fresh("g")
                keys.append(self.ex(item.expr, sc).alias(c))
                env[name] = ValueB(c)
        found: dict[Any, str] = {}
        for _, e in later:
            for x in A.walk(e):
                if isinstance(x, A.Call) and x.name in AGGREGATES and x not in found:
                    found[x] = self.fresh("a")
                    aggs.append(self.aggregate_call(x, sc).alias(found[x]))
        key_exprs = {i.expr: n for i, n in zip(items, names, strict=True) if env[n] is not None}
        df = sc.df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias(self.fresh("a"))]))
        inner = Scope(df, {n: b for n, b in env.items() if b is not None} | {c: ValueB(c) for c in found.values()})
        columns = [F.col(x) for x in Scope(df, {n: b for n, b in env.items() if b is not None}).columns()]
        for name, e in later:
            for x, c in found.items():
                e = _replaced(e, x, A.Var(c))
            for k, n in key_exprs.items():
                e = _replaced(e, k, A.Var(n))
            c = self.fresh("c")
            columns.append(self.ex(e, inner).alias(c))
            env[name] = ValueB(c)
        return Scope(df.select(*columns), env)

    def aggregate_call(self, x: A.Call, sc: Scope) -> Column:
        if x.star:
            return F.count(F.lit(1))
        if any(has_aggregate(a) for a in x.args):
            raise BindError("an aggregate inside an aggregate")
        b = sc.env.get(x.args[0].name) if isinstance(x.args[0], A.Var) else None
        if x.name == "count":
            if isinstance(b, NodeB):
                cols = [F.col(f"{b.c}__id"), *([F.col(f"{b.c}__label")] if len(b.labels) > 1 else [])]
            elif isinstance(b, RelB):
                cols = [F.col(f"{b.c}__eid")]
            elif isinstance(b, PathB):
                cols = [F.col(f"{b.c}__len")]
            else:
                cols = [self.ex(a, sc) for a in x.args]
            return F.count_distinct(*cols) if x.distinct else F.count(cols[0])
        e = self.ex(x.args[0], sc)
        if x.name == "collect":
            if isinstance(b, (NodeB, RelB, PathB)):
                e = F.when(F.col(b.columns()[0]).isNotNull(), e)
            return F.array_distinct(F.collect_list(e)) if x.distinct and b is not None else F.collect_set(e) if x.distinct else F.collect_list(e)
        if x.distinct and x.name == "sum":
            return F.sum_distinct(e)
        if x.distinct and x.name == "avg":
            return _avg_distinct(e)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[x.name](e)

    # ---- other sources

    def load_from(self, c: A.LoadFrom, sc: Scope) -> Scope:
        if sc.df is not None:
            raise BindError("LOAD FROM must come first")
        df = self.source(c.source, c.options, c.headers)
        names = df.columns
        cols = {n: self.fresh("f") for n in names}
        out = Scope(df.toDF(*cols.values()), {n: ValueB(x) for n, x in cols.items()})
        return self.where(c.where, out)

    def source(self, source: Any, options: dict, headers: list | None = None) -> DataFrame:
        if isinstance(source, list):
            return files.read(self.spark, source, options, headers)
        if isinstance(source, str):
            if source not in self.tables:
                raise BindError(f"no table or variable {source}")
            found = self.tables[source]
            return found() if callable(found) else found
        return self.query(source)

    def call_subquery(self, c: A.CallSubquery, sc: Scope) -> Scope:
        """Each branch is a pipeline over all rows so far; only the variables in brackets are seen in it."""
        sc = self.started(sc)
        names = c.vars if c.vars is not None else list(sc.env)
        for n in names:
            if n not in sc.env:
                raise BindError(f"no variable {n}")
        branches = c.query.parts if isinstance(c.query, A.Union) else [c.query]
        parts = []
        for q in branches:
            outer, self.uses = self.uses, _merged(self.uses, Uses(q))
            try:
                out = self.single(q, Scope(sc.df, {n: sc.env[n] for n in names}))
            finally:
                self.uses = outer
            parts.append(out)
        first = parts[0]
        if len(parts) == 1:
            return first
        df = first.df.select(*first.columns())
        for p in parts[1:]:
            if len(p.columns()) != len(first.columns()):
                raise BindError("the branches of CALL return different columns")
            df = df.union(p.df.select(*p.columns()))
        if not c.query.all:
            df = df.distinct()
        return Scope(df, first.env)

    def call_function(self, c: A.CallFunction, sc: Scope) -> Scope:
        name = c.name.lower()
        if name not in self.functions:
            raise BindError(f"no table function {c.name}")
        df = self.functions[name](self.graph, *[a.value if isinstance(a, A.Literal) else self.params[a.name] for a in c.args])
        wanted = c.yields or [(n, n) for n in df.columns]
        cols = {alias: self.fresh("f") for _, alias in wanted}
        df = df.select(*[F.col(n).alias(cols[alias]) for n, alias in wanted])
        env = {a: ValueB(x) for a, x in cols.items()}
        return self.where(c.where, Scope(df if sc.df is None else sc.df.crossJoin(df), sc.env | env))

    # ---- expressions

    def typed(self, e: Any, sc: Scope) -> tuple[Column, T.DataType]:
        c = self.ex(e, sc)
        if isinstance(e, _Bound):
            return c, e.type
        if any(isinstance(x, _Bound) for x in A.walk(e)):  # an element inside a lambda: Catalyst alone knows its type
            return c, T.NullType()
        return c, self.type_of(c, sc)

    def type_of(self, c: Column, sc: Scope) -> T.DataType:
        df = sc.df if sc.df is not None else self.spark.range(1)
        return df.select(c.alias("x")).schema["x"].dataType

    def value(self, name: str, sc: Scope) -> Column:
        """A variable as a value: structs for nodes, relationships and paths, null where an outer join left it out."""
        b = sc.env[name]
        if isinstance(b, NodeB):
            s = F.struct(self.graph.internal_id(F.col(f"{b.c}__label"), F.col(f"{b.c}__id")).alias("_ID"), F.col(f"{b.c}__label").alias("_LABEL"), *[F.col(f"{b.c}__p_{p}").alias(p) for p in b.props])
            return F.when(F.col(f"{b.c}__id").isNotNull(), s)
        if isinstance(b, RelB):
            src = self.graph.internal_id(F.col(f"{b.c}__slabel"), F.col(f"{b.c}__src"))
            dst = self.graph.internal_id(F.col(f"{b.c}__dlabel"), F.col(f"{b.c}__dst"))
            s = F.struct(F.col(f"{b.c}__eid").alias("_ID"), F.col(f"{b.c}__type").alias("_LABEL"), src.alias("_SRC_ID"), dst.alias("_DST_ID"), *[F.col(f"{b.c}__p_{p}").alias(p) for p in b.props])
            return F.when(F.col(f"{b.c}__eid").isNotNull(), s)
        if isinstance(b, PathB):
            if not b.full:
                raise BindError(f"the path {name} is not kept")
            s = F.struct(F.col(f"{b.c}__nodes").alias("nodes"), F.col(f"{b.c}__rels").alias("rels"), F.col(f"{b.c}__len").alias("length"))
            return F.when(F.col(f"{b.c}__len").isNotNull(), s)
        return F.col(f"`{b.c}`")

    def literal(self, v: Any) -> Column:
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return F.lit(v)
        if isinstance(v, int):
            if not -(2**63) <= v < 2**63:
                return F.lit(v).cast("decimal(20,0)") if v >= 0 else F.lit(v)
            return F.lit(v).cast("long") if not -(2**31) <= v < 2**31 else F.lit(v).cast("long")
        if isinstance(v, (list, tuple)):
            return F.array(*[self.literal(x) for x in v])
        if isinstance(v, dict):
            return F.struct(*[self.literal(x).alias(k) for k, x in v.items()])
        return F.lit(v)

    def ex(self, e: Any, sc: Scope) -> Column:
        if isinstance(e, A.Literal):
            return self.literal(e.value)
        if isinstance(e, A.Param):
            if e.name not in self.params:
                raise BindError(f"no value for ${e.name}")
            return self.literal(self.params[e.name])
        if isinstance(e, A.Var):
            if e.name not in sc.env:
                raise BindError(f"no variable {e.name}")
            return self.value(e.name, sc)
        if isinstance(e, A.Prop):
            return self.prop(e, sc)
        if isinstance(e, A.ListOf):
            return self.list_of([self.typed(x, sc) for x in e.items])
        if isinstance(e, A.MapOf):
            return F.struct(*[self.ex(x, sc).alias(k) for k, x in e.items])
        if isinstance(e, A.Case):
            return self.case(e, sc)
        if isinstance(e, A.Cast):
            if e.type == "INTERVAL" and isinstance(e.value, A.Literal):
                return ty.interval(e.value.value)
            c, t = self.typed(e.value, sc)
            return ty.cast(c, e.type, t)
        if isinstance(e, A.Slice):
            c = self.ex(e.of, sc)
            lo = self.ex(e.lo, sc) if e.lo is not None else F.lit(0)
            hi = self.ex(e.hi, sc) if e.hi is not None else F.size(c)
            return F.slice(c, (lo + 1).cast("int"), F.greatest(F.lit(0), F.least(hi, F.size(c)) - lo).cast("int"))
        if isinstance(e, A.Quantifier):
            of, kind = self.typed(e.of, sc)

            def holds(x: Column) -> Column:
                return self.ex(_replaced(e.where, A.Var(e.var), _Bound(x, kind.elementType)), sc)

            if e.kind == "all":
                return F.forall(of, holds)
            if e.kind == "any":
                return F.exists(of, holds)
            if e.kind == "none":
                return ~F.exists(of, holds)
            return F.size(F.filter(of, holds)) == 1
        if isinstance(e, _Bound):
            return e.column
        if isinstance(e, A.Op):
            return self.op(e, sc)
        if isinstance(e, A.Call):
            return self.call(e, sc)
        raise BindError(f"{type(e).__name__} cannot stand here")

    def list_of(self, items: list[tuple[Column, T.DataType]]) -> Column:
        kinds = {type(t) for _, t in items if not isinstance(t, T.NullType)}
        numeric = all(issubclass(k, T.NumericType) for k in kinds)
        if len(kinds) > 1 and not numeric:
            return F.struct(*[c.alias(f"_{i + 1}") for i, (c, _) in enumerate(items)])
        return F.array(*[c for c, _ in items])

    def prop(self, e: A.Prop, sc: Scope) -> Column:
        if isinstance(e.of, A.Var):
            b = sc.env.get(e.of.name)
            if b is None:
                raise BindError(f"no variable {e.of.name}")
            if isinstance(b, (NodeB, RelB)):
                if e.key in b.props:
                    return F.col(f"{b.c}__p_{e.key}")
                if e.key in b.known:
                    raise BindError(f"{e.of.name}.{e.key} is not loaded")
                raise BindError(f"{e.of.name} has no property {e.key}")
        return self.ex(e.of, sc)[e.key]

    def case(self, e: A.Case, sc: Scope) -> Column:
        out = None
        for test, value in e.whens:
            c = self.ex(test, sc) if e.subject is None else self.ex(A.Op("=", (e.subject, test)), sc)
            out = F.when(c, self.ex(value, sc)) if out is None else out.when(c, self.ex(value, sc))
        return out.otherwise(self.ex(e.default, sc)) if e.default is not None else out

    def identity(self, e: Any, sc: Scope) -> list[Column] | None:
        """What a node or relationship is compared by."""
        b = sc.env.get(e.name) if isinstance(e, A.Var) else None
        if isinstance(b, NodeB):
            return [F.col(f"{b.c}__id"), F.col(f"{b.c}__label")]
        if isinstance(b, RelB):
            return [F.col(f"{b.c}__eid"), F.col(f"{b.c}__type")]
        return None

    def op(self, e: A.Op, sc: Scope) -> Column:
        n = e.name
        if n in ("=", "<>"):
            a, b = self.identity(e.args[0], sc), self.identity(e.args[1], sc)
            if a and b:
                same = (a[0] == b[0]) & (a[1] == b[1])
                return same if n == "=" else ~same
        if n in ("is null", "is not null"):
            ident = self.identity(e.args[0], sc)
            b = sc.env.get(e.args[0].name) if isinstance(e.args[0], A.Var) else None
            c = ident[0] if ident else F.col(f"{b.c}__len") if isinstance(b, PathB) else self.ex(e.args[0], sc)
            return c.isNull() if n == "is null" else c.isNotNull()
        if n == "in" and isinstance(e.args[1], A.ListOf) and all(isinstance(x, (A.Literal, A.Param)) for x in e.args[1].items):
            return self.ex(e.args[0], sc).isin(*[self.ex(x, sc) for x in e.args[1].items])
        if n in ("and", "or", "xor", "not"):
            args = [self.ex(a, sc) for a in e.args]
            if n == "not":
                return ~args[0]
            a, b = args
            return a & b if n == "and" else a | b if n == "or" else (a | b) & ~(a & b)
        if n == "neg":
            return -self.ex(e.args[0], sc)
        typed = [self.typed(a, sc) for a in e.args]
        (a, ta), (b, tb) = typed
        if n in ("+", "-", "*"):
            return scalar.add(a, b, ta, tb, n)
        if n == "/":
            return scalar.divide(a, b, ta, tb)
        if n == "%":
            return scalar.modulo(a, b, ta, tb)
        if n == "^":
            return F.pow(a, b)
        if n in ("=", "<>", "<", "<=", ">", ">="):
            a, b = self.comparable(a, ta, b, tb)
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[n]
        if n == "=~":
            return F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        if n == "in":
            return F.array_contains(b, a)
        if n == "[]":
            if isinstance(ta, T.StructType) and isinstance(e.args[1], A.Literal):
                if not 0 <= e.args[1].value < len(ta.fields):
                    raise BindError("a list index is out of range")
                return a[ta.fields[e.args[1].value].name]
            return a[b.cast("int")]
        if n in ("&", "|"):
            return a.bitwiseAND(b) if n == "&" else a.bitwiseOR(b)
        if n in ("<<", ">>"):
            return F.call_function("shiftleft" if n == "<<" else "shiftright", a, b.cast("int"))
        raise BindError(f"no operator {n}")

    @staticmethod
    def comparable(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, Column]:
        """Texts meet dates and timestamps as such."""
        for t in (T.DateType, T.TimestampNTZType, T.TimestampType):
            if isinstance(ta, t) and isinstance(tb, T.StringType):
                return a, b.cast(ta)
            if isinstance(tb, t) and isinstance(ta, T.StringType):
                return a.cast(tb), b
        return scalar.comparable_intervals(a, ta, b, tb)

    def call(self, e: A.Call, sc: Scope) -> Column:
        n = e.name
        if n in self.functions.get("macro:", {}):
            return self.ex(self.unfolded(e), sc)
        b = sc.env.get(e.args[0].name) if e.args and isinstance(e.args[0], A.Var) else None
        if n in AGGREGATES:
            raise BindError(f"{n}() cannot stand here")
        if n == "id" and isinstance(b, NodeB):
            return self.graph.internal_id(F.col(f"{b.c}__label"), F.col(f"{b.c}__id"))
        if n == "id" and isinstance(b, RelB):
            return F.col(f"{b.c}__eid")
        if n in ("label", "labels"):
            if isinstance(b, NodeB):
                return F.col(f"{b.c}__label")
            if isinstance(b, RelB):
                return F.col(f"{b.c}__type")
            return self.ex(e.args[0], sc)["_label"]
        if n in ("start_node", "startnode", "end_node", "endnode") and isinstance(b, RelB):
            x, y = ("src", "slabel") if n.startswith("start") else ("dst", "dlabel")
            s = F.struct(self.graph.internal_id(F.col(f"{b.c}__{y}"), F.col(f"{b.c}__{x}")).alias("_ID"), F.col(f"{b.c}__{y}").alias("_LABEL"), F.col(f"{b.c}__{x}").alias("_KEY"))
            return F.when(F.col(f"{b.c}__eid").isNotNull(), s)
        if isinstance(b, PathB):
            if n == "length":
                return F.col(f"{b.c}__len").cast("long")
            if n == "cost":
                if not b.weighted:
                    raise BindError("cost() needs a weighted path")
                return F.col(f"{b.c}__cost")
            if n in ("nodes", "rels", "relationships"):
                return F.col(f"{b.c}__{'nodes' if n == 'nodes' else 'rels'}")
            if n == "is_trail":
                return self._all_different(F.transform(f"{b.c}__rels", lambda r: F.struct(r["_type"], r["_eid"])))
            if n == "is_acyclic":
                return self._all_different(F.transform(f"{b.c}__nodes", lambda v: F.struct(v["_label"], v["_id"])))
            if n in ("start_node", "end_node"):
                return F.element_at(f"{b.c}__nodes", 1 if n == "start_node" else -1)
        if n == "properties":
            key = e.args[1].value
            return F.transform(self.ex(e.args[0], sc), lambda x: x[key])
        if n in ("date_part", "datepart"):
            return scalar.date_part(e.args[0].value, self.ex(e.args[1], sc))
        if n in ("to_interval", "interval", "duration"):
            if isinstance(e.args[0], (A.Literal, A.Param)):
                return ty.interval(e.args[0].value if isinstance(e.args[0], A.Literal) else self.params[e.args[0].name])
            return self.ex(e.args[0], sc).cast("interval")
        if n == "list_creation":
            return self.list_of([self.typed(a, sc) for a in e.args])
        if n == "length":
            return F.length(self.ex(e.args[0], sc)).cast("long")
        if n == "struct_extract":
            return self.ex(e.args[0], sc)[e.args[1].value]
        if n in ("list_contains", "list_has"):
            return F.array_contains(self.ex(e.args[0], sc), self.ex(e.args[1], sc))
        args = [self.ex(a, sc) for a in e.args]
        if n in self.functions.get("scalar:", {}):
            return self.functions["scalar:"][n](*args)
        if n in scalar.PLAIN:
            return scalar.PLAIN[n](*args)
        raise BindError(f"no function {n}")

    def unfolded(self, e: A.Call) -> Any:
        """A macro's expression with the arguments in the place of its parameters, all at once."""
        m = self.functions["macro:"][e.name]
        given = list(e.args) + [d for _, d in m.params[len(e.args) :]]
        if len(e.args) > len(m.params) or any(x is None for x in given):
            raise BindError(f"{e.name} takes {len(m.params)} arguments")
        body = m.body
        for name, _ in m.params:
            body = _replaced(body, A.Var(name), A.Var(f"${name}"))
        for (name, _), value in zip(m.params, given, strict=True):
            body = _replaced(body, A.Var(f"${name}"), value)
        return body

    @staticmethod
    def _all_different(array: Column) -> Column:
        return F.size(F.array_distinct(array)) == F.size(array)


def _size(df: DataFrame) -> float:
    """The planner's estimate of a table's bytes, kept with it."""
    if not hasattr(df, "_estimated"):
        df._estimated = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df._estimated


class _Bound:
    """A column in the place of a variable inside a lambda."""

    def __init__(self, column: Column, type_: T.DataType):
        self.column, self.type = column, type_


def _avg_distinct(e: Column) -> Column:
    """The mean of the different values, as the mean of the set that sum and count make of them."""
    return F.sum_distinct(e.cast("double")) / F.count_distinct(e)


def _replaced(e: Any, old: Any, new: Any) -> Any:
    if e == old:
        return new
    if isinstance(e, tuple):
        return tuple(_replaced(x, old, new) for x in e)
    if isinstance(e, list):
        return [_replaced(x, old, new) for x in e]
    if hasattr(e, "__dataclass_fields__"):
        return type(e)(**{f: _replaced(getattr(e, f), old, new) for f in e.__dataclass_fields__})
    return e


def _merged(a: Uses | None, b: Uses) -> Uses:
    if a is not None:
        for v, keys in a.of.items():
            b.of.setdefault(v, set()).update(keys)
        b.paths |= a.paths
    return b


def replace_labels(m: A.Match, sc: Scope, shared: list[str]) -> A.Match:
    """The pattern with the labels of the outer bindings on its shared nodes."""

    def node(n: A.NodePattern) -> A.NodePattern:
        if n.var not in shared:
            return n
        own = sc.env[n.var].labels
        return replace(n, labels=tuple(x for x in own if not n.labels or x in n.labels) or own)

    return A.Match([replace(p, nodes=tuple(node(n) for n in p.nodes)) for p in m.paths], m.where, m.optional, m.hint)
