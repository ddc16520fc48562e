"""The pipeline's stages on small documents, each against what it should decide."""

import random

import pytest

import corpus_pipeline
from weftgraph.llm import pii, quality, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ko", "mi", "tu", "re", "sol", "fen"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    texts = [prose(i) for i in range(30)]
    texts[5] = texts[4]
    texts[6] = texts[4].replace(texts[4].split()[3], "changed", 1)
    texts[7] += " write to some.one@example.com now"
    texts += [None, "", "12345 !!", "too short"]
    rows = [(i, t, "en" if i % 5 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows + rows[:2], COLUMNS).coalesce(1).write.parquet(str(at / "documents.parquet"))
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mask_pii", "packing"]
    one = stages["language_id"](spark, docs, folder)
    assert one.columns == docs.columns and {x["doc_id"] for x in one.collect()} >= set(range(30)) and one.where("doc_id IN (30, 31, 32)").count() == 0
    two = stages["quality_rules"](spark, one, folder)
    assert {x["doc_id"] for x in two.collect()} == set(range(30)) and two.count() == 32
    three = stages["near_dedup"](spark, two, folder)
    ids = sorted(x["doc_id"] for x in three.collect())
    fps = {i: simhash.fingerprint(t) for i, t in two.select("doc_id", "text").collect()}
    gone = {b for b in fps for a in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4}
    assert ids == sorted(set(fps) - gone) and 5 not in ids
    four = stages["mask_pii"](spark, three, folder)
    assert four.columns == docs.columns and four.count() == three.count()
    text, n = four.where("doc_id = 7").select("text", "n_chars").first()
    assert "[EMAIL]" in text and n == len(text) and not pii.base_spans(text)
    assert sorted(x["doc_id"] for x in stages["packing"](spark, four, folder).select("doc_id").distinct().collect()) == ids


def test_run_and_empty_table(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert "sequence_id" in out.columns and out.count() > 20
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.P == 5


def test_near_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (None, prose(3)), (9, prose(3)), (7, prose(4)), (7, prose(5)), (5, prose(4)), (7, prose(4)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, prose(1)), (None, prose(2)), (9, prose(3)), (7, prose(5)), (5, prose(4)), (None, None)]
    assert sorted(map(repr, map(tuple, got.select("doc_id", "text").collect()))) == sorted(map(repr, want))


def test_clashing_columns_and_shared_ids_pass_through(spark, tmp_path):
    """Extra columns with the names that the stages use themselves, null and shared doc_ids, and repeated rows."""
    names = ["_row", "_uid", "lang_pred", "lang_rejected", "_lang_pred", "x0", "component_id", "spans", "more", "kept", "group", "fp"]
    texts = [prose(i) for i in range(12)]
    rows = [(None if i < 3 else 7 if i < 6 else i, t, "en", "s", len(t), *([f"v{i}"] * len(names))) for i, t in enumerate(texts)]
    schema = COLUMNS + ", " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([*rows, rows[11]], schema)
    want = sorted(rows, key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [f.name for f in spark.createDataFrame([], schema).schema], name
        got = sorted(map(tuple, docs.collect()), key=repr)
        assert got == (want if name in ("near_dedup", "mask_pii") else sorted([*want, rows[11]], key=repr)), name
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    packed = corpus_pipeline.best_fit_packing(spark, docs, "")
    assert packed.count() == 12


def test_run_leaves_only_what_its_result_reads(spark, folder):
    from pathlib import Path

    from weftgraph.llm import common

    at = Path(common.shared_folder(spark).removeprefix("file://"))
    before = set(at.iterdir()) if at.exists() else set()
    out = corpus_pipeline.run(spark, folder)
    after = set(at.iterdir()) - before
    assert out.count() > 0 and len(after) == 2  # the last stage's input, and its pieces
