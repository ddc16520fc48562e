"""Paths of variable length as bounded iterative joins.

``hops`` has one row per way to go on: {from, fl, to, tl, rel, node, ok}. WALK, TRAIL and ACYCLIC carry the outer rows
along. The shortest-path forms run level by level from the distinct roots, with visited pairs anti-joined away, and
each level is written once, so neither the plan nor the lineage grows with the number of hops. Where both ends are
given, two fronts meet half way.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels that are joined in one plan before a level is written.
UNROLLED = 3
#: The bound of an open hop range.
MOST_HOPS = 30

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this session's own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weftgraph-levels-")
        folder = _OWN[app]
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def walk(front: DataFrame, hops: DataFrame, c: str, lo: int, hi: int, mode: str, full: bool) -> DataFrame:
    """``front`` (with {c}__end, {c}__el, {c}__len, {c}__ok and, if full, {c}__nodes, {c}__rels) taken on by lo to hi hops."""
    levels = [front] if lo == 0 else []
    now, keep = front, front.columns
    for h in range(1, hi + 1):
        step = hops.where(F.col("h_from").isNotNull())
        on = (now[f"{c}__end"] == step["h_from"]) & (now[f"{c}__el"] == step["h_fl"])
        joined = now.where(f"`{c}__ok`").join(step, on)
        if mode == "ACYCLIC":
            joined = joined.where(~F.exists(f"{c}__nodes", lambda n: (n["_id"] == F.col("h_to")) & (n["_label"] == F.col("h_tl"))))
        if mode == "TRAIL":
            joined = joined.where(~F.exists(f"{c}__rels", lambda r: (r["_eid"] == F.col("h_eid")) & (r["_type"] == F.col("h_rel._type"))))
        new = {
            f"{c}__end": F.col("h_to"), f"{c}__el": F.col("h_tl"), f"{c}__len": F.col(f"{c}__len") + 1, f"{c}__ok": F.col("h_ok"),
        }
        if full:
            new |= {f"{c}__nodes": F.concat(f"{c}__nodes", F.array("h_node")), f"{c}__rels": F.concat(f"{c}__rels", F.array("h_rel"))}
        now = joined.select(*[new[x].alias(x) if x in new else F.col(f"`{x}`") for x in keep])
        if h >= UNROLLED and h < hi:
            now = written(now)
            if now.isEmpty():
                break
        if h >= lo:
            levels.append(now)
    if not levels:
        return now.limit(0)
    return reduce(lambda a, b: a.unionByName(b), levels)


_ENDS = ["root", "rootl", "end", "el"]


def _begun(roots: DataFrame, hops: DataFrame, state: list[str], turned: bool = False) -> DataFrame:
    """The front before the first hop, with what ``state`` says of eids, nodes, rels and n (number of paths)."""
    made = {"eids": F.array().cast("array<bigint>"), "n": F.lit(1).cast("long")}
    if "nodes" in state:
        kind = {x: hops.schema[x].dataType.simpleString() for x in ("h_node", "h_rel")}
        made |= {"nodes": F.array().cast(f"array<{kind['h_node']}>") if turned else F.array("node"), "rels": F.array().cast(f"array<{kind['h_rel']}>")}
    return roots.select("root", "rootl", F.col("root").alias("end"), F.col("rootl").alias("el"), F.lit(True).alias("ok"), *[made[x].alias(x) for x in state])


def _stepped(now: DataFrame, hops: DataFrame, visited: DataFrame | None, state: list[str], every: bool, turned: bool = False) -> DataFrame:
    """One hop on from ``now``, without what was visited; of paths with the same ends one, or their number, if the state allows."""
    j = now.where("ok").join(hops, (now["end"] == hops["h_from"]) & (now["el"] == hops["h_fl"]))
    new = {"end": F.col("h_to"), "el": F.col("h_tl"), "ok": F.lit(True) if turned else F.col("h_ok")}
    new |= {"eids": F.concat("eids", F.array("h_eid"))} if "eids" in state else {}
    new |= {"nodes": F.concat("nodes", F.array("h_node")), "rels": F.concat("rels", F.array("h_rel"))} if "nodes" in state else {}
    step = j.select(*[new[x].alias(x) if x in new else x for x in now.columns])
    if visited is not None:
        step = step.join(visited, _ENDS, "left_anti")
    if state == ["n"]:
        return step.groupBy(*_ENDS, "ok").agg(F.sum("n").alias("n"))
    if not every:
        rest = F.struct("ok", *state)
        least = F.min_by(rest, F.reverse("eids") if turned else F.col("eids")) if "eids" in state else F.max(rest)
        return step.groupBy(*_ENDS).agg(least.alias("p")).select(*_ENDS, "p.*")
    return step


def _state(every: bool, full: bool) -> list[str]:
    """Only what is read is carried and shuffled: nothing but the ends if lengths alone are asked for."""
    return ["eids", "nodes", "rels"] if full else ["n"] if every else []


def _unfolded(found: DataFrame, every: bool, full: bool) -> DataFrame:
    """A row for each path where only their number was carried."""
    return found.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).drop("_one", "n") if every and not full else found


def shortest(roots: DataFrame, hops: DataFrame, lo: int, hi: int, every: bool, full: bool, enough: int | None = None, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (root, rootl, end, el, len[, nodes, rels]): one, or with ``every`` all, shortest paths from each root to each end.

    Roots are distinct (root, rootl[, node]). The root is not visited at first, so a cycle leads back to it. Of several
    shortest paths the one with the least edge ids in order is taken. No further level is built once ``enough`` paths
    to nodes of ``labels`` are found, so a LIMIT by length reads as many levels as it needs.
    """
    state = _state(every, full)
    now = _begun(roots, hops, state)
    found, visited, got = [], None, 0
    for h in range(1, hi + 1):
        now = written(_stepped(now, hops, visited, state, every))
        if now.isEmpty():
            break
        reached = now.select(*_ENDS).distinct()
        visited = reached if visited is None else visited.unionByName(reached)
        if h >= lo:
            found.append(now.withColumn("len", F.lit(h)))
            if enough is not None:
                fits = now if labels is None else now.where(F.col("el").isin(*labels))
                got += fits.agg(F.sum("n")).first()[0] or 0 if state == ["n"] else fits.count()
                if got >= enough:
                    break
    return _unfolded(reduce(lambda a, b: a.unionByName(b), found) if found else now.limit(0).withColumn("len", F.lit(0)), every, full)


def shortest_between(pairs: DataFrame, hops: DataFrame, hi: int, every: bool, full: bool) -> DataFrame:
    """As ``shortest`` from 1 to ``hi`` hops, for given pairs (root, rootl, end, el[, node]) of both ends.

    Two fronts grow level by level towards each other, from the roots and, against the hops, from the ends; each turn
    takes the smaller one. A pair is done when its fronts meet, and fronts of done pairs stop. So each side reaches
    about half of the path's length instead of all that is within it.
    """
    state = _state(every, full)
    turn = {"h_from": "h_to", "h_fl": "h_tl", "h_to": "h_from", "h_tl": "h_fl"}
    back = hops.select(*[F.col(turn.get(x, x)).alias(x) for x in hops.columns])
    open_ = written(pairs.select(*_ENDS).distinct())
    starts = pairs.select("root", "rootl", *(["node"] if full else [])).dropDuplicates(["root", "rootl"])
    side = {"f": _begun(starts, hops, state), "b": _begun(pairs.select(F.col("end").alias("root"), F.col("el").alias("rootl")).distinct(), hops, state, True)}
    visited: dict[str, DataFrame | None] = {"f": None, "b": None}
    depth, size = {"f": 0, "b": 0}, {"f": 0, "b": 0}
    found, left = [], open_.count()
    while sum(depth.values()) < hi and left:
        x = min("fb", key=lambda k: (size[k], depth[k]))
        mine = ("root", "rootl") if x == "f" else ("end", "el")
        wanted = open_.select(F.col(mine[0]).alias("root"), F.col(mine[1]).alias("rootl")).distinct()
        front = side[x].join(wanted, ["root", "rootl"], "left_semi")
        # a hop tells whether one may go on from its target, so against the hops it is asked of all but the first
        ways = hops if x == "f" else back.where("h_ok") if depth["b"] else back
        side[x] = written(_stepped(front, ways, visited[x], state, every, x == "b"))
        depth[x] += 1
        size[x] = side[x].count()
        if not size[x]:
            break
        reached = side[x].select(*_ENDS).distinct()
        visited[x] = reached if visited[x] is None else visited[x].unionByName(reached)
        f, b = side["f"].where("ok") if depth["b"] else side["f"], side["b"]
        f = f.select(*[F.col(c).alias(f"f_{c}") for c in f.columns])
        b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
        met = open_.join(f, (F.col("root") == F.col("f_root")) & (F.col("rootl") == F.col("f_rootl")))
        met = met.join(b, (F.col("end") == F.col("b_root")) & (F.col("el") == F.col("b_rootl")) & (F.col("f_end") == F.col("b_end")) & (F.col("f_el") == F.col("b_el")))
        if state == ["n"]:
            new = met.groupBy(*_ENDS).agg(F.sum(F.col("f_n") * F.col("b_n")).alias("n"))
        elif full:
            new = met.select(*_ENDS, *[F.concat(f"f_{c}", F.reverse(f"b_{c}")).alias(c) for c in state])
            if not every:
                new = new.groupBy(*_ENDS).agg(F.min_by(F.struct(*state), "eids").alias("p")).select(*_ENDS, "p.*")
        else:
            new = met.select(*_ENDS).distinct()
        new = written(new)
        if done := (new.select(*_ENDS).distinct() if every and full else new).count():
            found.append(new.withColumn("len", F.lit(sum(depth.values()))))
            open_, left = written(open_.join(new.select(*_ENDS), _ENDS, "left_anti")), left - done
    if not found:
        found = [_begun(starts, hops, state).drop("ok").limit(0).withColumn("len", F.lit(0))]
    return _unfolded(reduce(lambda a, b: a.unionByName(b), found), every, full)


def cheapest(roots: DataFrame, hops: DataFrame, lo: int, hi: int, weight: str, every: bool, full: bool) -> DataFrame:
    """Least-cost paths by rounds of relaxation; weights must not be negative. The root is an end only for lo = 0.

    A round extends the paths that the last one made cheaper; it ends when none got cheaper, or at hi hops.
    """
    w = F.col(f"h_rel.{weight}").cast("double")
    hops = hops.withColumn("h_w", F.when(w < 0, F.raise_error(F.lit("negative weight"))).otherwise(w))
    base = ["root", "rootl", "end", "el", "cost", "len", "ok", "eids"] + (["nodes", "rels"] if full else [])
    now = roots.select(
        "root", "rootl", F.col("root").alias("end"), F.col("rootl").alias("el"), F.lit(0.0).alias("cost"), F.lit(0).alias("len"), F.lit(True).alias("ok"), F.array().cast("array<bigint>").alias("eids"),
        *([F.array("node").alias("nodes"), F.array().cast(f"array<{hops.schema['h_rel'].dataType.simpleString()}>").alias("rels")] if full else []),
    )
    key = ["root", "rootl", "end", "el"]
    best = front = now
    for _ in range(hi):
        j = front.where("ok").join(hops, (front["end"] == hops["h_from"]) & (front["el"] == hops["h_fl"]))
        new = {"end": F.col("h_to"), "el": F.col("h_tl"), "cost": F.col("cost") + F.col("h_w"), "len": F.col("len") + 1, "ok": F.col("h_ok"), "eids": F.concat("eids", F.array("h_eid"))}
        if full:
            new |= {"nodes": F.concat("nodes", F.array("h_node")), "rels": F.concat("rels", F.array("h_rel"))}
        step = j.select(*[new[x].alias(x) if x in new else x for x in base])
        old = best.groupBy(*key).agg(F.min("cost").alias("old"))
        step = step.join(old, key, "left").where(F.col("old").isNull() | ((F.col("cost") <= F.col("old")) if every else (F.col("cost") < F.col("old"))))
        if every:
            least = step.groupBy(*key).agg(F.min("cost").alias("least"))
            step = step.join(least, key).where("cost = least").select(*base).join(best.select(*key, "eids"), [*key, "eids"], "left_anti").select(*base)
        else:
            step = step.groupBy(*key).agg(F.min_by(F.struct(*base[4:]), F.struct("cost", "len", "eids")).alias("p")).select(*key, "p.*")
        front = written(step)
        if front.isEmpty():
            break
        merged = best.unionByName(front)
        if every:
            least = merged.groupBy(*key).agg(F.min("cost").alias("least"))
            best = written(merged.join(least, key).where("cost = least").select(*base))
        else:
            best = written(merged.groupBy(*key).agg(F.min_by(F.struct(*base[4:]), F.struct("cost", "len", "eids")).alias("p")).select(*key, "p.*"))
    return best if lo == 0 else best.where(F.col("len") >= lo)
