"""The queries op1 to op10 over the tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, langid, licenses, packing, pii, quality, resample, simhash, toxicity
from .common import fold_sample, held_out, materialize, session_for_texts, table

#: The bound of op3's sample of labelled rows.
TARGET_TEXTS = 20_000
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so each embedding is the media column: a series that is rendered as tones."""
    session_for_texts(spark)
    fps = materialize(chroma.fingerprint_media(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", chroma.render_vector))
    return chroma.align_recordings(fps, F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for_texts(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: TARGET_TEXTS of the texts labelled quality 1, those with the least hashes of id. Their ids are broadcast,
    bounded by that number, so whole texts are not shuffled to meet their labels."""
    session_for_texts(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = fold_sample(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct(), ["doc_id"], TARGET_TEXTS)
    return resample.resample(documents.join(F.broadcast(good.withColumn("_target", F.lit(True))), "doc_id", "left"), share=0.8)


def op4_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for_texts(spark)
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    decoded = bpe.decode_documents(encoded, TOKENIZER)
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for_texts(spark)
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_toxicity_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for_texts(spark)
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(documents, labels.where(~held_out("doc_id", 3, 1)))
    scored = toxicity.score_toxicity(documents, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for_texts(spark)
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_licenses", F.size("licenses").cast("long"))


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for_texts(spark)
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    more = F.transform("more", lambda s: F.struct(F.lit(pii.OTHER).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.KINDS]
    n_other, n_spans = F.size("more").cast("long").alias("n_other"), (F.size("spans") + F.size("more")).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(text(F.col("spans")), 256).alias("base_sha256"), text(F.concat("spans", more)).alias("spans"), n_other, n_spans)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for_texts(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kept_back = held_out("doc_id", 5, 0)
    dictionaries = langid.fit_dictionaries(documents.where(~kept_back))
    found = langid.identify_languages(documents.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", kept_back.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for_texts(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chroma_fingerprints,
        op2_simhash_near_dedup,
        op3_importance_resampling,
        op4_bpe_chunk_reuse,
        op5_quality_mcd,
        op6_toxicity_levenshtein,
        op7_license_scan,
        op8_pii_bootstrap,
        op9_language_id,
        op10_best_fit_packing,
    )
}
ORACLE_SQL: dict[str, str] = {}
