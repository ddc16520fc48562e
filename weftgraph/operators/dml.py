"""Changes as new snapshots: CREATE, MERGE, SET, DELETE, COPY FROM and COPY TO.

A clause that changes the graph first writes the rows it works on, so that reading and changing the same tables in
one statement sees the state before it. Appended rows are unions, updates are left joins on the key, deletions are
anti joins; nothing is collected.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..catalog import CatalogError, NodeType, PropertyGraph, RelTriplet
from ..functions.types import system_default
from ..plans import ast as A
from ..plans.lower import Lowering, Uses
from ..sources import files
from .paths import written
from .scope import BindError, NodeB, RelB, Scope

_CHANGES = (A.Create, A.Merge, A.SetItems, A.Delete)


def changes(s: Any) -> bool:
    return isinstance(s, (A.CreateNodeTable, A.CreateRelTable, A.DropTable, A.AlterTable, A.CopyFrom)) or any(isinstance(x, _CHANGES) for x in A.walk(s))


def run(q: Any, low: Lowering) -> DataFrame | None:
    """Runs a query that changes the graph; its rows if it ends in RETURN."""
    if not isinstance(q, A.Single):
        raise BindError("a UNION cannot change the graph")
    low.uses = Uses(q)
    for c in q.clauses:  # whatever is set or used to create is loaded
        for target, _ in c.items if isinstance(c, A.SetItems) else [*c.on_match, *c.on_create] if isinstance(c, A.Merge) else []:
            low.uses.add(target.of.name, target.key)
    sc, returned = Scope(None), False
    for c in q.clauses:
        if isinstance(c, _CHANGES):
            sc = low.started(sc)
            sc = Scope(written(sc.df.select(*sc.columns()) if sc.env else sc.df.withColumn("_one", F.lit(1))), sc.env)
            sc = {A.Create: create, A.Merge: merge, A.SetItems: set_items, A.Delete: delete}[type(c)](c, low, sc)
        else:
            sc = low.clause(c, sc)
            returned = isinstance(c, A.Projection) and c.last
    return low.returned(sc) if returned else None


def _fresh_eids(df: DataFrame) -> DataFrame:
    """Edge ids for new edges, written at once so that they stay."""
    return written(df.withColumn("_eid", F.xxhash64(F.expr("uuid()")).cast("long")))


def _literal_default(t: NodeType | RelTriplet, name: str):
    kind = t.df.schema[name].dataType
    return t.defaults.get(name, system_default(kind)).cast(kind)


def append_nodes(g: PropertyGraph, label: str, rows: DataFrame, keep_duplicates: bool = False) -> None:
    """Appends rows (columns: any of the properties); a key that exists already or is given twice is an error."""
    n = g.node(label)
    if n.key not in rows.columns:
        raise CatalogError(f"{label} needs its key {n.key}")
    full = rows.select(*[F.coalesce(F.col(f"`{f.name}`").cast(f.dataType), _literal_default(n, f.name)).alias(f.name) if f.name in rows.columns and f.name != n.key else F.col(f"`{n.key}`").cast(f.dataType).alias(f.name) if f.name == n.key else _literal_default(n, f.name).alias(f.name) for f in n.df.schema])
    full = written(full)
    if full.where(F.col(n.key).isNull()).limit(1).count():
        raise CatalogError(f"a key of {label} is null")
    both = full.select(n.key).unionByName(n.df.select(n.key).join(full.select(n.key), n.key, "left_semi"))
    twice = both.groupBy(n.key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise CatalogError(f"{label} {twice[0][0]!r} exists already")
    n.df = n.df.unionByName(full)


def append_rels(g: PropertyGraph, t: RelTriplet, rows: DataFrame) -> None:
    """Appends edges (_src, _dst and any of the properties) between nodes that exist."""
    src, dst = g.node(t.src), g.node(t.dst)
    own = [F.coalesce(F.col(f"`{p}`").cast(t.df.schema[p].dataType), _literal_default(t, p)).alias(p) if p in rows.columns else _literal_default(t, p).alias(p) for p in t.props]
    new = rows.select(F.col("_src").cast(g.key_type(t.src)).alias("_src"), F.col("_dst").cast(g.key_type(t.dst)).alias("_dst"), *own)
    new = _fresh_eids(new)
    for side, n in (("_src", src), ("_dst", dst)):
        lost = new.join(n.df.select(F.col(n.key).alias(side)), side, "left_anti").limit(1).collect()
        if lost:
            raise CatalogError(f"{t.type}: no {n.label} has the key {lost[0][side]!r}")
    t.df = t.df.unionByName(new.select("_src", "_dst", "_eid", *t.props))


# ---- clauses


def create(c: A.Create, low: Lowering, sc: Scope) -> Scope:
    for p in c.paths:
        for n in p.nodes:
            if n.var not in sc.env:
                sc = create_node(n, low, sc)
        for i, r in enumerate(p.rels):
            left, right = (p.nodes[i], p.nodes[i + 1]) if r.direction != "in" else (p.nodes[i + 1], p.nodes[i])
            if len(r.types) != 1 or r.direction == "both":
                raise BindError("a new relationship needs one type and a direction")
            create_rel(r, sc.env[left.var], sc.env[right.var], low, sc)
    return sc


def create_node(n: A.NodePattern, low: Lowering, sc: Scope) -> Scope:
    if len(n.labels) != 1:
        raise BindError("a new node needs one label")
    t = low.graph.node(n.labels[0])
    for k, _ in n.props:
        if k not in t.props:
            raise BindError(f"{t.label} has no property {k}")
    given = {k: low.ex(e, sc) for k, e in n.props}
    append_nodes(low.graph, t.label, sc.df.select(*[v.alias(k) for k, v in given.items()]))
    c = low.fresh(n.var)
    kinds = {f.name: f.dataType for f in t.df.schema}
    columns = {f"{c}__id": low.graph.as_id(given[t.key]), f"{c}__label": F.lit(t.label)}
    columns |= {f"{c}__p_{k}": given[k].cast(kinds[k]) if k in given else _literal_default(t, k) for k in t.props}
    return Scope(sc.df.withColumns(columns), sc.env | {n.var: NodeB(c, (t.label,), tuple(t.props), tuple(t.props))})


def create_rel(r: A.RelPattern, a: NodeB, b: NodeB, low: Lowering, sc: Scope) -> None:
    found = [t for t in low.graph.triplets(r.types) if t.src in a.labels and t.dst in b.labels]
    if not found:
        raise BindError(f"no {r.types[0]} leads from {'|'.join(a.labels)} to {'|'.join(b.labels)}")
    for t in found:
        for k, _ in r.props:
            if k not in t.props:
                raise BindError(f"{t.type} has no property {k}")
        rows = sc.df.where((F.col(f"{a.c}__label") == t.src) & (F.col(f"{b.c}__label") == t.dst))
        append_rels(low.graph, t, rows.select(F.col(f"{a.c}__id").alias("_src"), F.col(f"{b.c}__id").alias("_dst"), *[low.ex(e, sc).alias(k) for k, e in r.props]))


def merge(c: A.Merge, low: Lowering, sc: Scope) -> Scope:
    """MERGE of one node by its key, or of a pattern of relationships, part by part: nodes that are not bound yet are merged by their keys."""
    if not c.path.rels:
        return merge_node(c.path.nodes[0], c.on_match, c.on_create, low, sc)
    for n in c.path.nodes:
        if n.var not in sc.env:
            sc = merge_node(n, [], [], low, sc)
    for i, r in enumerate(c.path.rels):
        ends = c.path.nodes[i : i + 2]
        if r.hops is not None or len(r.types) != 1 or r.direction == "both":
            raise BindError("MERGE takes relationships with one type and a direction")
        sc = merge_rel(ends, r, c.on_match, c.on_create, low, sc)
    return sc


def merge_rel(ends: tuple, r: A.RelPattern, on_match: list, on_create: list, low: Lowering, sc: Scope) -> Scope:
    """Rows whose relationship exists, with the given properties, are matched; for others one is created for each pair of ends and properties."""
    left, right = ends if r.direction != "in" else ends[::-1]
    a, b = sc.env[left.var], sc.env[right.var]
    found = [t for t in low.graph.triplets(r.types) if t.src in a.labels and t.dst in b.labels]
    if not found:
        raise BindError(f"no {r.types[0]} leads from {'|'.join(a.labels)} to {'|'.join(b.labels)}")
    made = []
    for t in found:
        for k, _ in r.props:
            if k not in t.props:
                raise BindError(f"{t.type} has no property {k}")
        here = sc.df.where((F.col(f"{a.c}__label") == t.src) & (F.col(f"{b.c}__label") == t.dst))
        given = [low.ex(e, sc).cast(t.df.schema[k].dataType).alias(k) for k, e in r.props]
        rows = written(here.select(F.col(f"{a.c}__id").alias("_src"), F.col(f"{b.c}__id").alias("_dst"), *given).where("_src IS NOT NULL AND _dst IS NOT NULL").distinct())
        old = t.df.select(low.graph.as_id(F.col("_src")).alias("_src"), low.graph.as_id(F.col("_dst")).alias("_dst"), *[k for k, _ in r.props])
        before = written(t.df.select("_eid"))
        append_rels(low.graph, t, rows.join(old, ["_src", "_dst", *[k for k, _ in r.props]], "left_anti"))
        made.append((t, before))
    known = tuple(dict.fromkeys(p for t in found for p in t.props))
    for target, _ in [*on_match, *on_create]:
        if target.of.name == r.var:
            low.uses.add(r.var, target.key)
    matched = low.match(A.Match([A.PathPattern(tuple(ends), (replace(r, named=True),))]), sc)
    e = matched.env[r.var]
    fresh = [t.df.select(F.col("_eid").alias("_new"), F.lit(t.src).alias("_from"), F.lit(t.dst).alias("_to")).join(before, F.col("_new") == F.col("_eid"), "left_anti") for t, before in made]
    new = written(reduce(lambda x, y: x.unionByName(y), fresh))
    on = (F.col(f"{e.c}__eid") == F.col("_new")) & (F.col(f"{e.c}__slabel") == F.col("_from")) & (F.col(f"{e.c}__dlabel") == F.col("_to"))
    for items, how in ((on_create, "left_semi"), (on_match, "left_anti")):
        if items:
            set_items(A.SetItems(items), low, Scope(written(matched.df.join(new, on, how)), matched.env))
    if not (on_create or on_match):
        return matched
    return low.match(A.Match([A.PathPattern(tuple(ends), (replace(r, named=True),))]), sc) if known else matched


def merge_node(n: A.NodePattern, on_match: list, on_create: list, low: Lowering, sc: Scope) -> Scope:
    """Rows whose key exists are matched, each other key is created once."""
    if len(n.labels) != 1:
        raise BindError("MERGE takes nodes with one label")
    t = low.graph.node(n.labels[0])
    given = dict(n.props)
    if t.key not in given:
        raise BindError(f"MERGE needs the key {t.key}")
    kind = low.graph.key_type(t.label)
    rows = sc.df.select(*[low.ex(e, sc).alias(k) for k, e in given.items()]).withColumn(t.key, F.col(t.key).cast(kind))
    old = t.df.select(t.key)
    new = written(rows.join(old, t.key, "left_anti").dropDuplicates([t.key]))
    seen = written(rows.join(old, t.key, "left_semi").select(t.key).distinct())
    append_nodes(low.graph, t.label, new)
    for keys, items in ((seen, on_match), (new.select(t.key), on_create)):
        if items:
            b = NodeB(low.fresh(n.var), (t.label,), tuple(t.props), tuple(t.props))
            inner = low.scan(replace(n, props=()), (t.label,), Scope(None))
            b = inner.env[n.var]
            inner = low.load_props(n.var, tuple(t.props), inner)
            kept = inner.df.join(keys.select(low.graph.as_id(F.col(t.key)).alias("_k")), F.col("_k") == F.col(f"{b.c}__id"), "left_semi")
            set_items(A.SetItems(items), low, Scope(written(kept), inner.env))
    matched = low.scan(replace(n, props=()), (t.label,), Scope(None))
    matched = low.load_props(n.var, tuple(t.props), matched)
    b = matched.env[n.var]
    df = sc.df.withColumn("_k", low.graph.as_id(low.ex(given[t.key], sc).cast(kind)))
    return Scope(df.join(matched.df, F.col("_k") == F.col(f"{b.c}__id")).drop("_k"), sc.env | matched.env)


def set_items(c: A.SetItems, low: Lowering, sc: Scope) -> Scope:
    """Of several values for one node or edge the greatest is taken, so the result does not depend on row order."""
    g, values = low.graph, [(target, low.ex(e, sc)) for target, e in c.items]
    df = written(sc.df.withColumns({f"_set{i}": v for i, (_, v) in enumerate(values)}))
    env = dict(sc.env)
    for i, (target, _) in enumerate(values):
        b = sc.env.get(target.of.name)
        if isinstance(b, NodeB):
            for label in b.labels:
                n = low.graph.node(label)
                if target.key not in n.props:
                    continue
                if target.key == n.key:
                    raise BindError("the primary key cannot be set")
                new = df.where(F.col(f"{b.c}__label") == label).groupBy(F.col(f"{b.c}__id").alias("_k")).agg(F.max(f"_set{i}").alias("_v"), F.lit(True).alias("_given"))
                n.df = _updated(n.df, low.graph.as_id(F.col(n.key)), new, target.key, n)
        elif isinstance(b, RelB):
            for t in (t for name in b.types for t in low.graph.rels[name] if (t.src, t.dst) in b.ends):
                if target.key not in t.props:
                    continue
                here = (F.col(f"{b.c}__type") == t.type) & (F.col(f"{b.c}__slabel") == t.src) & (F.col(f"{b.c}__dlabel") == t.dst)
                new = df.where(here).groupBy(F.struct(*[F.col(f"{b.c}__{x}") for x in ("eid", "src", "dst")]).alias("_k")).agg(F.max(f"_set{i}").alias("_v"), F.lit(True).alias("_given"))
                t.df = _updated(t.df, _edge_key(g, t), new, target.key, t)
        else:
            raise BindError(f"{target.of.name} has no properties")
        if target.key not in b.known:
            raise BindError(f"{target.of.name} has no property {target.key}")
        column = f"{b.c}__p_{target.key}"
        kind = df.schema[column].dataType if column in df.columns else None
        df = df.withColumn(column, F.col(f"_set{i}").cast(kind) if kind else F.col(f"_set{i}"))
        if target.key not in b.props:
            env[target.of.name] = replace(b, props=b.props + (target.key,))
    return Scope(df.drop(*[f"_set{i}" for i in range(len(values))]), env)


def _edge_key(g: PropertyGraph, t: RelTriplet) -> Column:
    """An edge's id with its ends, as ids are hashes."""
    return F.struct(F.col("_eid").alias("eid"), g.as_id(F.col("_src")).alias("src"), g.as_id(F.col("_dst")).alias("dst"))


def _updated(df: DataFrame, key, new: DataFrame, prop: str, t: NodeType | RelTriplet) -> DataFrame:
    """A null value sets the property's default, for stored properties are never null."""
    joined = df.withColumn("_key", key).join(new, F.col("_key") == F.col("_k"), "left")
    value = F.when(F.col("_given"), F.coalesce(F.col("_v").cast(df.schema[prop].dataType), _literal_default(t, prop))).otherwise(F.col(prop))
    return written(joined.withColumn(prop, value).select(*df.columns))


def delete(c: A.Delete, low: Lowering, sc: Scope) -> Scope:
    """Deleting a node deletes its edges, with or without DETACH: a graph never holds an edge without its ends."""
    g = low.graph
    for e in c.exprs:
        b = sc.env.get(e.name) if isinstance(e, A.Var) else None
        if isinstance(b, NodeB):
            for label in b.labels:
                n = g.node(label)
                gone = written(sc.df.where(F.col(f"{b.c}__label") == label).select(F.col(f"{b.c}__id").alias("_k")).where("_k IS NOT NULL").distinct())
                n.df = n.df.join(gone, g.as_id(F.col(n.key)) == F.col("_k"), "left_anti")
                for t in (t for ts in g.rels.values() for t in ts):
                    for side, end in (("_src", t.src), ("_dst", t.dst)):
                        if end == label:
                            t.df = t.df.join(gone, g.as_id(F.col(side)) == F.col("_k"), "left_anti")
        elif isinstance(b, RelB):
            for t in (t for name in b.types for t in g.rels[name] if (t.src, t.dst) in b.ends):
                here = (F.col(f"{b.c}__type") == t.type) & (F.col(f"{b.c}__slabel") == t.src) & (F.col(f"{b.c}__dlabel") == t.dst)
                gone = written(sc.df.where(here).select(F.struct(*[F.col(f"{b.c}__{x}") for x in ("eid", "src", "dst")]).alias("_k")).distinct())
                t.df = t.df.join(gone, _edge_key(g, t) == F.col("_k"), "left_anti")
        else:
            raise BindError("DELETE takes nodes and relationships")
    return sc


# ---- bulk


def copy_from(s: A.CopyFrom, low: Lowering) -> None:
    """Loads nodes (columns in the order of the properties, or by name), or edges (the first two columns are the keys).

    A table that does not exist is made from the file: the first column is a node's key; with options ``from`` and
    ``to`` it is a relationship.
    """
    g = low.graph
    rows = low.source(s.source, {k: v for k, v in s.options.items() if k not in ("from", "to", "auto_detect")})
    if s.name not in g.nodes and s.name not in g.rels:
        if s.options.get("auto_detect") is False:
            raise CatalogError(f"no table {s.name}")
        rows = written(rows)
        if "from" in s.options:
            g.add_rel(s.name, s.options["from"], s.options["to"], rows.limit(0).withColumn("_eid", F.lit(0).cast("long")), rows.columns[0], rows.columns[1])
        else:
            g.add_node(s.name, rows.columns[0], rows.limit(0))
    if s.name in g.nodes:
        n = g.nodes[s.name]
        names = s.columns or n.props
        if not set(rows.columns) <= set(n.props):  # by position
            if len(rows.columns) != len(names):
                raise CatalogError(f"{s.name} has {len(names)} properties, the source {len(rows.columns)} columns")
            rows = rows.toDF(*names)
        append_nodes(g, s.name, rows)
        return
    ts = [t for t in g.rels[s.name] if s.options.get("from", t.src) == t.src and s.options.get("to", t.dst) == t.dst]
    if len(ts) != 1:
        raise CatalogError(f"{s.name} needs the options from and to")
    names = s.columns or ts[0].props
    rest = rows.columns[2:]
    by_name = set(rest) <= set(ts[0].props)
    if not by_name and len(rest) != len(names):
        raise CatalogError(f"{s.name} has {len(names)} properties, the source {len(rest)}")
    append_rels(g, ts[0], rows.toDF("_src", "_dst", *(rest if by_name else names)))


def copy_to(s: A.CopyTo, low: Lowering) -> None:
    files.write(low.query(s.query), s.path, s.options)


