"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

A stage's result must be written before a stage after the next one is called; then what it wrote for itself is deleted.
Stages tell rows apart by a number that is written with them, never by doc_id or by a hash, so rows whose doc_id is
null or shared are neither lost nor mixed up. Columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stage(apply: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage; the last one's own tables stay, as its result is the pipeline's and is read when the caller likes."""

    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        from weftgraph.llm import common

        common.session_for_texts(spark)
        with common.stage_scratch(spark, docs, final=apply.__name__ == "best_fit_packing"):
            return apply(spark, docs, sf_dir)

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; lang becomes the language found. The fit is on the labels that docs has.

    Rejected are texts that are null or have no letter, and those between languages.
    """
    from weftgraph.llm import langid

    prefix = "_lang_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = langid.identify_languages(docs, langid.fit_dictionaries(docs), prefix=prefix)
    return found.where(~F.col(f"{prefix}rejected")).withColumn("lang", F.col(f"{prefix}pred")).select(*docs.columns)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    from weftgraph.llm import common, quality

    uid = common.fresh(docs, "_row")
    rows = common.with_row_id(docs, uid)
    good = quality.quality_rules(rows, keep=(uid,)).where("kept").select(uid)
    return rows.join(good, uid, "left_semi").select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the least doc_id, a null one last, then with the least hash of the row."""
    from weftgraph.llm import common, simhash

    uid = common.fresh(docs, "_row")
    rows = common.with_row_id(docs, uid)
    found = simhash.near_duplicates(rows, id_col=uid).select(F.col("doc_id").alias("u"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"), F.col(uid).alias("u"))
    first = rows.select(order.alias("o")).join(found, F.col("o.u") == F.col("u")).groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.u").alias(uid))
    return rows.join(first, uid, "left_semi").select(*docs.columns)


@_stage
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked by its kind; n_chars is the new length."""
    from weftgraph.llm import pii

    return pii.mask_pii(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    import public_tokenizers

    from weftgraph.llm import packing

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_personal_data),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. All but the last stage's rows are written to the shared folder and reread; what a stage wrote for itself goes once they are."""
    from weftgraph.llm import common

    docs, held = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with common.scratch(spark):
            path = common.written(stage(spark, docs, sf_dir))
        if held:
            common.delete(spark, held)
        docs, held = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


#: None: no stage before the last can be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
