"""Quality rules: base statistics of whole texts, and robust multivariate outliers per language and source.

Everything here is DataFrame functions. A document's statistics become a vector of transformed rates. For each
(lang, source) the minimum-covariance-determinant estimate is found by concentration steps: from a start on, the mean
and covariance of the ``support`` share of rows nearest by Mahalanobis distance are taken again and again. Several
starts (STARTS) run side by side, and the one that ends with the least determinant is taken. One step is one
aggregation: rows are summed into (group, start, distance bucket) moments, so a group that holds a third of all rows is
added up map-side, and the rest works on a table with at most ``BUCKETS`` rows a group and start. Distances are scaled
so that their median is that of a chi-square law, and rows beyond ``cutoff`` are rejected.

What is approximate: the covariance has the squares of FLOORS added, as in regularised forms of the estimate, and the
bucket at the edge of the support counts in part, all its rows alike. So a step may raise the determinant by what the
rows of one bucket differ in distance (a factor of at most exp(1 / PER_UNIT) in 1 + distance), and no more; and the
result is a local optimum of a few starts, as in all fast forms of the method.

Nulls: a null text has no words and fails the base rules; null lang or source is a group of its own. Groups of fewer
than ``least_rows`` are pooled by language; pools that are still small join the language's largest group, or else are
pooled all together, or else join the largest group of all. Only a table with fewer than ``least_rows`` texts with
words has no verdict beyond the base rules. Very long texts are read whole. Repeated rows count, and get the same
verdict; ties do. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, WORD_SPACE, materialize

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Added to each coordinate's scale: spreads below these are no evidence of junk.
FLOORS = (0.05, 0.05, 0.06, 0.06, 0.05)
#: Shares of repeated lines and words are of so many more, so that one chance repeat in a short text stays within the floors.
MORE_LINES, MORE_WORDS = 5, 50
#: Starts of the concentration: medians and quartile spreads; and the mean and covariance of all rows.
STARTS = 2
P = len(FLOORS)
CHI2_MEDIAN_5 = 4.351
BUCKETS, PER_UNIT = 800, 32
SALTS = 32


def _bound(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once, whatever the number of uses."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(grams: Column) -> Column:
    """Words covered by 3-word windows (64-bit hashes in order) that occur at least twice."""

    def covered(s: Column) -> Column:
        size = F.size(s)

        def kept(e: Column, j: Column) -> Column:
            before = (j > 0) & (F.get(s, j - 1)["h"] == e["h"])
            after = (j < size - 1) & (F.get(s, j + 1)["h"] == e["h"])
            return F.when(before | after, e["i"]).otherwise(F.lit(-1))

        at = F.sort_array(F.filter(F.transform(s, kept), lambda i: i >= 0))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
        )

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_bound(pairs, covered))


def base_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(WORD_SPACE))
    df = df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD_PATTERN))
    n = F.size("_words")
    grams = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def without(chars: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, chars, ""))

    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": (F.char_length(text) - without(WORD_SPACE)).cast("long"),
            "n_symbols": without(SYMBOLS).cast("long"),
            "n_capitals": without(CAPITALS).cast("long"),
            "n_dup_lines": _bound(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")),
            "_n_lines": _bound(lines, F.size),
            "_grams": grams,
        }
    )
    df = df.withColumn("n_repeat_words", _repeat_words(F.col("_grams"))).drop("_words", "_grams")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(chars / words),
        F.log1p(F.col("n_symbols") / words),
        F.col("n_dup_lines") / (F.col("_n_lines") + MORE_LINES),
        F.col("n_repeat_words") / (F.col("n_words") + MORE_WORDS),
        F.sqrt(F.col("n_capitals") / chars),
    ]


def _cholesky(prefix: str) -> dict[str, Column]:
    """Columns l_ij of the lower Cholesky factor, from columns of a covariance; used one after the other."""
    out = {}
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"{prefix}{j}_{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out[f"l{i}_{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}")
    return out


def _distance2() -> Column:
    """Squared Mahalanobis distance of x from m under the factor l: forward substitution, each part bound once."""
    total, ys = F.lit(0.0), []
    for i in range(P):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}_{k}") * ys[k]
        ys.append(y / F.col(f"l{i}_{i}"))
        total = total + ys[i] * ys[i]
    return total


_PARAMS = [f"m{i}" for i in range(P)] + [f"l{i}_{j}" for i in range(P) for j in range(i + 1)]


def _factored(groups: DataFrame, kept: list[str]) -> DataFrame:
    for name, c in _cholesky("c").items():
        groups = groups.withColumn(name, c)
    return groups.select(*kept, *_PARAMS)


_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"s{j}_{i}" for i in range(P) for j in range(i + 1))]


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(P)]
    return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"s{j}_{i}") for i in range(P) for j in range(i + 1)]]


def _from_moments(g: DataFrame) -> DataFrame:
    """Means and regularised covariances from summed moments, factored."""
    for i in range(P):
        g = g.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(P):
        for j in range(i + 1):
            c = F.col(f"s{j}_{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            g = g.withColumn(f"c{j}_{i}", F.greatest(c, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) if i == j else c)
    return _factored(g, ["group", "start"])


def _first_estimates(rows: DataFrame) -> DataFrame:
    """(group, start) with parameters, for each of STARTS."""
    spread = [F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i in range(P)]
    both = materialize(rows.groupBy("group").agg(*spread, *_moments()))
    g = both.withColumn("start", F.lit(0))
    for i in range(P):
        scale = (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
        g = g.withColumn(f"m{i}", F.col(f"q{i}")[1].cast("double"))
        for j in range(i + 1):
            g = g.withColumn(f"c{j}_{i}", scale * scale + F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
    return _factored(g, ["group", "start"]).unionByName(_from_moments(both.withColumn("start", F.lit(1))))


def salted(params: DataFrame) -> DataFrame:
    return params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _bucketed(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with d2 and its bucket. The parameters, one row a group, are repeated for each salt, so a hot group's rows are
    dealt over SALTS tasks; whether they are broadcast is the planner's choice by size."""
    return rows.join(salted(params), ["group", "salt"]).withColumn("d2", _distance2()).withColumn("bucket", F.least(F.floor(F.log1p("d2") * PER_UNIT), F.lit(BUCKETS - 1)).cast("int"))


def _concentrate(rows: DataFrame, params: DataFrame, support: float) -> DataFrame:
    """One concentration step of every start: mean and covariance of the nearest ``support`` of a group, the bucket at its edge in part."""
    moments = _bucketed(rows, params).groupBy("group", "start", "bucket").agg(*_moments())
    one = Window.partitionBy("group", "start")
    moments = moments.withColumn("before", F.sum("n").over(one.orderBy("bucket")) - F.col("n")).withColumn("need", F.sum("n").over(one) * support)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("need") - F.col("before")) / F.col("n")))
    g = moments.withColumn("part", part).where("part > 0").groupBy("group", "start").agg(*[F.sum(F.col("part") * F.col(c)).alias(c) for c in _SUMS])
    return _from_moments(g)


def _best(params: DataFrame) -> DataFrame:
    """Of each group's starts the one with the least determinant, the first of equal ones."""
    size = F.lit(0.0)
    for i in range(P):
        size = size + F.log(F.col(f"l{i}_{i}"))
    least = F.min_by(F.struct("start", *_PARAMS), F.struct(F.round(size, 9).alias("d"), F.col("start").alias("s")))
    return params.groupBy("group").agg(least.alias("p")).select("group", "p.*")


def _scaled(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The parameters with the factor that brings each group's median distance to the chi-square median, 1 at least."""
    counts = _bucketed(rows, params).groupBy("group", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("group").orderBy("bucket"))).withColumn("all", F.sum("n").over(Window.partitionBy("group")))
    half = counts.where(2 * F.col("upto") >= F.col("all")).groupBy("group").agg(F.min("bucket").alias("b"), F.max("all").alias("rows"))
    median = F.exp((F.col("b") + 0.5) / PER_UNIT) - 1
    return params.join(half, "group").withColumn("scale", F.greatest(median / CHI2_MEDIAN_5, F.lit(1.0))).drop("b")


def quality_rules(
    df: DataFrame, support: float = 0.75, steps: int = 4, cutoff: float = 30.0, least_rows: int = 100, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep``, the statistics, base_failed, distance2 (scaled; null for texts without words) and kept.

    A column of ``keep`` that is named like one of these is replaced by it.
    """
    kept = {c: f"_keep{i}" for i, c in enumerate(keep) if c.lower() not in _OUT}
    own = df.select(*[F.col(f"`{c}`").alias(k) for c, k in kept.items()], F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    stats = base_statistics(own, "_text").drop("_text")
    stats = materialize(stats.withColumns({f"x{i}": F.round(v, 6) for i, v in enumerate(_vector())}).withColumn("_uid", F.monotonically_increasing_id()))
    used = stats.where("n_words > 0")
    groups = _grouped(materialize(used.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))), least_rows)
    named = salted(groups).withColumnRenamed("salt", "_s")
    rows = used.withColumn("salt", F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int"))
    rows = rows.join(named, (F.col("salt") == F.col("_s")) & F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_source").eqNullSafe(F.col("_gs"))).drop("_gl", "_gs", "_s")
    params = _first_estimates(rows)
    for _ in range(steps):
        params = _concentrate(rows, params, support)
    params = materialize(_scaled(rows, materialize(_best(params))))
    judged = _bucketed(rows, params).select("_uid", F.when(F.col("rows") >= least_rows, F.col("d2") / F.col("scale")).alias("distance2"))
    out = stats.join(judged, "_uid", "left")
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))
    return out.select(*[F.col(k).alias(c) for c, k in kept.items()], *_OUT[:-1], verdict.alias("kept"))


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept"]


def _grouped(pairs: DataFrame, least_rows: int) -> DataFrame:
    """(_gl, _gs, group): the group of each language and source, from their numbers of rows."""
    own = F.to_json(F.struct("_lang", "_source"))
    language = Window.partitionBy("_lang")
    pairs = pairs.withColumn("big", F.col("n") >= least_rows)
    small = F.sum(F.when(~F.col("big"), F.col("n")).otherwise(0)).over(language)
    largest = F.max(F.when(F.col("big"), F.struct("n", own.alias("g")))).over(language)["g"]
    level = F.when(F.col("big"), own).when(small >= least_rows, F.to_json(F.struct("_lang"))).otherwise(largest)
    pairs = materialize(pairs.withColumn("group", level))
    left, most = pairs.agg(F.sum(F.when(F.col("group").isNull(), F.col("n"))), F.max(F.when(F.col("group").isNotNull(), F.struct("n", "group")))["group"]).first()
    rest = "all" if (left or 0) >= least_rows or most is None else most
    return materialize(pairs.select(F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"), F.coalesce("group", F.lit(rest)).alias("group")))
