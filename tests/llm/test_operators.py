"""The ten operators on small tables, against brute force, round trips and planted cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import bpe, chroma, components, langid, licenses, packing, pii, quality, resample, simhash, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(20_000))
EDGE = [None, "", " ", "\n\n", "a", "same text of five words", "same text of five words", "<|endoftext|> x<|endoftext|>", "é" * 40, "中文 字　符", "🙂👩‍👩‍👧 ok", "x" * 3000, LONG]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, ids string, fp string, kept string, h string, spans string"


def docs(spark, texts, lang="en", source="s"):
    """Documents with further columns whose names clash with the operators' own."""
    rows = [(i, t, lang, source, 0, 1, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, words=80, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ko", "mi", "tu", "re"]) for _ in range(1 + r.randrange(vocabulary) % 5)) for _ in range(words))


# ---- 1


def tone(freqs, seconds=0.4, rate=8000):
    t = np.arange(int(seconds * rate)) / rate
    return np.concatenate([np.sin(2 * np.pi * f * t) for f in freqs]).astype(np.float32)


def wav(samples, rate=8000):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((samples * 20000).astype("<i2").tobytes())
    return out.getvalue()


def aligned(fps, queries, **how):
    """Rows by id, and the matches of each id."""
    rows, matches = {}, {}
    for x in chroma.align_recordings(fps, queries, **how).collect():
        rows[x["id"]] = x
        if x["match_id"] is not None:
            matches.setdefault(x["id"], []).append(x)
    return rows, matches


def test_chroma_aligns_shifted_and_noisy_recordings(spark):
    r = np.random.default_rng(0)
    scale = 220 * 2 ** (np.arange(24) / 12)
    tune, other = tone(r.choice(scale, 20)), tone(r.choice(scale, 20))
    late = np.concatenate([tone(r.choice(scale, 3)), tune])
    noisy = tune + 0.05 * r.standard_normal(len(tune)).astype(np.float32)
    rows = [(0, wav(tune)), (1, wav(late)), (2, wav(0.9 * noisy / np.abs(noisy).max())), (3, wav(other)), (4, wav(tune)), (5, None), (6, wav(tune[:500]))]
    df = spark.createDataFrame(rows, "rec long, audio binary").withColumn("id", F.lit("clash"))
    fps = chroma.fingerprint_media(df, "audio", "rec").cache()
    got, found = aligned(fps, F.col("id") < 2)
    assert len(got) == 7 and got[4]["class_id"] == 0 and got[5]["n_frames"] == 0 == got[6]["n_frames"]
    matches = {m["match_id"]: m for m in found[0]}
    assert set(matches) == {1, 2}
    assert abs(matches[1]["offset"] * chroma.HOP - (len(late) - len(tune))) <= 2 * chroma.HOP and matches[2]["offset"] == 0
    a, b = (chroma.fingerprint(*chroma.read_wav(rows[i][1])) for i in (0, 1))
    offset, equal, error = chroma.best_offset(a, b)
    assert offset == matches[1]["offset"] and error == pytest.approx(matches[1]["error"])
    assert set(found) == {0, 1} and chroma.best_offset(a, np.zeros(0, np.uint32)) is None


def test_chroma_integral_filters_and_empty_table(spark):
    samples, rate = chroma.render_vector([0.1, None, -1.0, float("nan")] * 8)
    assert rate == chroma.RATE and len(samples) == 32 * chroma.NOTE
    fps = chroma.fingerprint_media(spark.createDataFrame([], "i long, v array<float>"), "v", "i", chroma.render_vector)
    assert chroma.align_recordings(fps, F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("noise", [0.1, 0.15])
def test_chroma_recall_of_noisy_copies(spark, noise):
    """Against the best of all offsets: recordings within most_error are found, also where few frames stay equal."""
    r = np.random.default_rng(int(100 * noise))
    vectors = [[float(x) for x in v] for v in r.standard_normal((120, 64))]
    copies = [[float(x) for x in np.array(v) + noise * r.standard_normal(64)] for v in vectors]
    df = spark.createDataFrame(list(enumerate(vectors + copies)), "i long, v array<double>")
    fps = chroma.fingerprint_media(df, "v", "i", chroma.render_vector).cache()
    fp = {x["id"]: np.array(x["fp"], np.int32).view(np.uint32) for x in fps.collect()}

    def error(a, b, o):
        x, y = a[max(0, -o) :], b[max(0, o) :]
        n = min(len(x), len(y))
        return np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)

    want = {i for i in range(120) if min(error(fp[i], fp[i + 120], o) for o in range(chroma.LEAST_OVERLAP - len(fp[i]), len(fp[i]) - chroma.LEAST_OVERLAP + 1)) <= 0.2}
    got = {i for i, own in aligned(fps, F.col("id") < 120)[1].items() if i + 120 in {m["match_id"] for m in own}}
    assert len(want) >= 20 and len(want & got) >= 0.9 * len(want)


def test_chroma_recall_of_shifted_cropped_and_noisy_recordings(spark):
    """A table of planted copies against exhaustive alignment of every query with every recording."""
    r = np.random.default_rng(5)
    tunes = [r.standard_normal(64) for _ in range(60)]
    rows = list(tunes)
    for i, v in enumerate(tunes):
        cut = v[int(r.integers(0, 20)) : 64 - int(r.integers(0, 12))] if i % 3 else np.concatenate([r.standard_normal(int(r.integers(1, 20))), v])
        rows.append(cut + 0.08 * r.standard_normal(len(cut)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "i long, v array<double>")
    fps = chroma.fingerprint_media(df, "v", "i", chroma.render_vector).cache()
    fp = {x["id"]: np.array(x["fp"], np.int32).view(np.uint32) for x in fps.collect()}
    want = set()
    for i in range(60):
        for j in range(120):
            a, b, least = fp[i], fp[j], chroma.LEAST_OVERLAP
            errors = [np.bitwise_count(a[max(0, -o) :][:n] ^ b[max(0, o) :][:n]).sum() / (32 * n) for o in range(least - len(a), len(b) - least + 1) if (n := min(len(a) - max(0, -o), len(b) - max(0, o))) >= least]
            if i != j and min(errors) <= 0.2:
                want.add((i, j))
    offsets = {(i, m["match_id"]): (m["offset"], m["equal"]) for i, own in aligned(fps, F.col("id") < 60)[1].items() for m in own}
    got = set(offsets)
    assert got <= want and len(want) >= 25 and len(got) >= 0.9 * len(want)
    assert all(chroma.best_offset(fp[i], fp[j])[:2] == o for (i, j), o in offsets.items())


def test_chroma_unreadable_media(spark):
    eight_bit = wav(tone([440]))[:34] + b"\x08\x00" + wav(tone([440]))[36:]
    values = [None, b"", b"RIFF", b"no sound at all", eight_bit, wav(tone([440] * 12))[:-5001], wav(tone([440] * 12))]
    df = spark.createDataFrame(list(enumerate(values)), "i long, a binary")
    got = {x["id"]: x for x in chroma.fingerprint_media(df, "a", "i").collect()}
    assert [got[i]["readable"] for i in range(5)] == [None, False, False, False, False] and got[6]["readable"]
    assert all(got[i]["n_frames"] == 0 for i in range(5)) and got[6]["n_frames"] > 100
    assert chroma.align_recordings(chroma.fingerprint_media(df, "a", "i"), F.lit(True)).count() == 7


# ---- 2


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_covering_masks_miss_no_pair():
    for radius in (2, 4):
        masks = simhash.covering_masks(radius)
        r = random.Random(radius)
        for _ in range(5000):
            d = sum(1 << i for i in r.sample(range(64), r.randint(0, radius)))
            assert any(d & m == 0 for m in masks)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    texts = list(EDGE)
    for i in range(12):
        words = prose(i, 300).split()
        texts.append(" ".join(words))
        for _ in range(r.randrange(4)):
            w = list(words)
            w[r.randrange(300)] = "changed"
            texts.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    got = {x["doc_id"]: x for x in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: x["fp"] & (2**64 - 1) for i, x in got.items()} == fps
    roots = brute_components(sorted(set(fps.values())), 4)
    least = {}
    for i in sorted(fps, reverse=True):
        least[roots[fps[i]]] = i
    assert {i: x["component_id"] for i, x in got.items()} == {i: least[roots[f]] for i, f in fps.items()}


@pytest.mark.parametrize("most", [3, 4096])
def test_links_in_large_and_small_buckets(spark, most):
    r, values = random.Random(most), set()
    for _ in range(25):
        c = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            values.add(simhash._signed(c))
            for i in r.sample(range(64), r.randint(0, 3)):
                c ^= 1 << i
    values = sorted(values)
    edges = simhash.near_duplicate_links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, most)
    got = {x["node"]: x["root"] for x in components.connected_components(edges).collect()}
    want = brute_components(values, 4)
    assert {v: got.get(v, v) for v in values} == want


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# ---- 3


def test_resampling_prefers_the_target_and_takes_exactly_k(spark):
    good = [("alpha beta gamma delta " * 10).strip() for _ in range(20)]
    bad = [("noise junk spam trash " * 10).strip() for _ in range(20)]
    df = docs(spark, good + bad + EDGE).withColumn("_target", F.col("doc_id") < 10)
    rows = resample.resample(df, k=20, buckets=1000).collect()
    assert len(rows) == 40 + len(EDGE) and sum(x["selected"] for x in rows) == 20
    assert {x["doc_id"] for x in rows if x["selected"]} >= set(range(20))
    keys = sorted((x["key"] for x in rows), reverse=True)
    assert all(x["selected"] == (x["key"] >= keys[19]) for x in rows)
    again = resample.resample(df, k=20, buckets=1000).collect()
    assert sorted(again) == sorted(rows)


@pytest.mark.parametrize("k", [0, 1, 7, 100])
def test_gumbel_top_k_with_ties(spark, k):
    rows = [(i, 0.0, 0.0, float(i % 3)) for i in range(30)]
    got = resample.gumbel_top_k(spark.createDataFrame(rows, "doc_id long, log_weight double, mean_log_weight double, key double"), k).collect()
    chosen = [x for x in got if x["selected"]]
    assert len(chosen) == min(k, 30)
    assert not chosen or len(chosen) == 30 or min(x["key"] for x in chosen) >= max(x["key"] for x in got if not x["selected"])


def test_gumbel_top_k_of_extreme_keys(spark):
    r = random.Random(6)
    keys = [1.7e308, -1.7e308, 5e-324, 0.0, 1e-9, 1e-9 * (1 + 2**-52), 9.1e8, 9.2e8, -1.2e9, -1.3e9, 9e8 + 1e-6] + [r.gauss(0, 1) * 10 ** r.randint(-12, 12) for _ in range(60)]
    df = spark.createDataFrame([(i, 0.0, 0.0, x) for i, x in enumerate(keys)], "doc_id long, log_weight double, mean_log_weight double, key double").cache()
    for k in (1, 2, 3, 10, 35, 69, 70):
        got = [x["key"] for x in resample.gumbel_top_k(df, k).where("selected").collect()]
        assert sorted(got, reverse=True) == sorted(keys, reverse=True)[:k]


def test_log_ratios_against_plain_counts(spark):
    texts = [prose(i, 30, 60) for i in range(30)] + EDGE
    df = docs(spark, texts).withColumn("_target", F.col("doc_id") % 3 == 0)
    grams = resample.HashedGrams(500)
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        words = re.findall(r"\w+|[^\w\s]+", (t or "").lower())
        h = [xxhash.xxh64_intdigest(w) for w in words]
        own = Counter(x % 500 for x in h)
        assert Counter(grams(t)[: len(h)].tolist()) == own and len(grams(t)) == max(0, 2 * len(h) - 1)
        raw.update(grams(t).tolist())
        target.update(grams(t).tolist() if i % 3 == 0 else [])
    n, m = sum(raw.values()) + 500, sum(target.values()) + 500
    want = [np.log((target[b] + 1) / m) - np.log((raw[b] + 1) / n) for b in range(500)]
    got = resample.fit_log_ratios(df, 500)
    assert np.allclose(got, want)
    weights = {x["doc_id"]: x["log_weight"] for x in resample.importance(df, got).collect()}
    assert all(weights[i] == pytest.approx(sum(want[g] for g in grams(t).tolist()) if len(grams(t)) else -1e9) for i, t in enumerate(texts))


def test_resampling_of_nothing(spark):
    assert resample.resample(docs(spark, []).withColumn("_target", F.lit(True)), share=0.5, buckets=100).count() == 0


# ---- 4 and 10


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteBpe(TOKENIZER)


def test_ranks_are_those_of_the_rank_file(encoder):
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert all(encoder.token_bytes[i] == t for t, i in ranks.items())


@pytest.mark.parametrize("chunking", [{}, {"mean_bits": 3, "least": 4, "most": 40}])
def test_chunked_ids_are_exact(encoder, chunking):
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "Z", "12", "'s", "'", "!", "...", "<|endoftext|>", "<|endo", "\x1c", "\x85", "中", "🙂", "́", "the", "\r\n", "​", "　", "ſ"]
    chunked = bpe.ChunkedEncoder(encoder, **chunking)
    for text in [t or "" for t in EDGE] + ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(1500)]:
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(chunked.encode(text), "<u4").tolist() == want == np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert encoder.decode(chunked.encode(text)) == encoder.library.decode(want, skip_special_tokens=False) == text


def test_every_letter_outside_the_fast_range_goes_to_the_library(encoder):
    for c in range(0x250):
        for text in (f"a{chr(c)}b", f" {chr(c)} 1{chr(c)}"):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_shared_passages_are_encoded_once(encoder):
    chunked = bpe.ChunkedEncoder(encoder)
    passage = prose(1, 2000)
    chunked.encode("one start " + passage)
    before = chunked.encoded
    chunked.encode("quite another beginning of it " + passage)
    assert chunked.encoded - before <= 3 and chunked.reused > 3


def test_encode_and_decode_documents(spark, encoder):
    encoded = bpe.encode_documents(docs(spark, EDGE), TOKENIZER)
    got = {x["id"]: x for x in bpe.decode_documents(encoded, TOKENIZER).collect()}
    for i, t in enumerate(EDGE):
        ids = encoder.library.encode(t or "", add_special_tokens=False).ids
        assert hashlib.sha256(got[i]["ids"]).digest() == hashlib.sha256(np.array(ids, "<u4").tobytes()).digest() and got[i]["decoded"] == (t or "")
    assert bpe.encode_documents(docs(spark, []), TOKENIZER).count() == 0


def brute_bins(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            b = min(fits, key=lambda b: bins[b])
            bins[b] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


def test_best_fit_decreasing_against_brute_force():
    r = random.Random(0)
    for _ in range(300):
        capacity = r.choice([5, 10, 37, 64])
        lengths = [r.randint(1, capacity) for _ in range(r.randrange(70))]
        classes = packing.best_fit_decreasing(Counter(lengths), capacity)
        bins = [c for n, c in classes for _ in range(n)]
        assert sorted(x for b in bins for x in b) == sorted(lengths)
        assert sorted(capacity - sum(b) for b in bins) == brute_bins(lengths, capacity)


def test_pack_documents(spark, encoder):
    texts = [*EDGE, *(prose(i, 30 + 37 * i) for i in range(25)), "word " * 2047, "word " * 2048, "word " * 5000]
    rows = packing.pack_documents(docs(spark, texts), TOKENIZER, 512).collect()
    pieces, bins = {}, {}
    for x in rows:
        pieces.setdefault(x["doc_id"], []).append(x)
        bins.setdefault(x["sequence_id"], []).append(x)
    for i, t in enumerate(texts):
        ids = [*encoder.library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda x: x["piece"])
        assert [x["piece"] for x in own] == list(range(len(own))) and sum(x["length"] for x in own) == len(ids)
        assert all(x["length"] == 512 for x in own[1:]) and 1 <= own[0]["length"] <= 512
        for x in own:
            part = np.array(ids[x["start"] : x["start"] + x["length"]], "<u4")
            assert len(part) == x["length"] and zlib.crc32(part.tobytes()) == x["ids_crc32"]
    for own in bins.values():
        at = 0
        for x in sorted(own, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 512
    assert len(bins) == len(brute_bins([x["length"] for x in rows], 512))
    assert packing.pack_documents(docs(spark, []), TOKENIZER, 512).count() == 0


# ---- 5


def brute_statistics(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics_and_outliers(spark):
    texts = [*EDGE, *(prose(i, 60 + i % 40, 5) for i in range(150)), *("\n".join([prose(i, 40), "same line", "x $ y", "same line"]) for i in range(20)), "a b c " * 40, " ".join(f"{w}$$$ #" for w in prose(9, 90).split())]
    got = {x["doc_id"]: x for x in quality.quality_rules(docs(spark, texts), least_rows=20).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute_statistics(t)
        assert not (x["kept"] and x["base_failed"])
    clean = range(len(EDGE), len(EDGE) + 150)
    assert all(got[i]["kept"] for i in clean) and not got[len(texts) - 1]["kept"]


def test_quality_runs_no_python_and_takes_null_groups(spark):
    df = docs(spark, [prose(i, 60) for i in range(30)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    out = quality.quality_rules(df.unionByName(df.limit(3)), least_rows=5)
    assert out.count() == 33
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    assert quality.quality_rules(docs(spark, [])).count() == 0


def brute_mcd(x, support, floors, starts=150, seed=0):
    """Concentration with exact subsets of ``support`` rows from many random starts: the least log determinant, its mean and covariance."""
    r, n, best = np.random.default_rng(seed), len(x), None
    h, more = round(support * n), np.diag(np.square(floors))
    for _ in range(starts):
        own = x[r.choice(n, x.shape[1] + 1, replace=False)]
        for _ in range(30):
            m, c = own.mean(axis=0), np.cov(own.T, bias=True) + more
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = x[np.argsort(d2, kind="stable")[:h]]
        m, c = own.mean(axis=0), np.cov(own.T, bias=True) + more
        if best is None or np.linalg.slogdet(c)[1] < best[0] - 1e-12:
            best = (np.linalg.slogdet(c)[1], m, c)
    return best


@pytest.mark.parametrize("bad", [0.0, 0.1, 0.2])
def test_covariance_determinant_against_brute_force(spark, bad):
    r = np.random.default_rng(int(100 * bad))
    n = 600
    x = r.multivariate_normal(np.zeros(5), 0.04 * (np.eye(5) + 0.5), n)
    x[: int(bad * n)] = r.multivariate_normal([3, 2, 1, 0, 2], 0.02 * np.eye(5), int(bad * n))
    x = np.round(x, 6)
    frame = spark.createDataFrame([(i, "g", i % quality.SALTS, *map(float, v)) for i, v in enumerate(x)], "_uid long, group string, salt int, " + ", ".join(f"x{i} double" for i in range(5))).cache()
    params = quality._first_estimates(frame)
    for _ in range(4):
        params = quality._concentrate(frame, params, 0.75)
    params = quality.materialize(quality._best(params))
    p = params.first()
    got = 2 * sum(np.log(p[f"l{i}_{i}"]) for i in range(5))
    logdet, m, c = brute_mcd(x, 0.75, quality.FLOORS)
    assert abs(got - logdet) < 0.1
    assert np.allclose([p[f"m{i}"] for i in range(5)], m, atol=0.03)
    mine = {y["_uid"]: y["d2"] for y in quality._bucketed(frame, params).select("_uid", "d2").collect()}
    want = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    assert all((mine[i] > 60) == (want[i] > 60) for i in range(n) if not 45 < want[i] < 80) and all(mine[i] > 60 for i in range(int(bad * n)))


def test_quality_rejects_repetition_just_under_the_base_limit(spark):
    r = random.Random(3)

    def line():
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(12))

    lines = ["\n".join(line() for _ in range(12)) for _ in range(150)]
    odd = "\n".join([line()] * 5 + [line() for _ in range(7)])
    chance = "\n".join([lines[0], lines[0].split("\n")[0]])  # one chance repeat
    texts = [*lines, odd, chance]
    got = {x["doc_id"]: x for x in quality.quality_rules(docs(spark, texts)).collect()}
    assert not got[150]["base_failed"] and not got[150]["kept"]
    assert all(got[i]["kept"] for i in [*range(150), 151])


def test_small_groups_join_the_nearest_large_one(spark):
    texts = [prose(i, 60) for i in range(60)]
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 40, "big").when(F.col("doc_id") < 45, "small").otherwise(F.col("doc_id").cast("string")))
    df = df.withColumn("lang", F.when(F.col("doc_id") >= 55, F.lit("rare")).otherwise(F.col("lang"))).withColumn("x0", F.lit(5)).withColumn("kept", F.lit("x")).withColumn("group", F.lit("y"))
    got = quality.quality_rules(df, least_rows=20, keep=("doc_id", "x0", "kept", "group"))
    assert got.columns == ["doc_id", "x0", "group", *quality._OUT]
    rows = got.collect()
    assert len(rows) == 60 and all(x["distance2"] is not None and x["x0"] == 5 and x["group"] == "y" for x in rows)
    alone = quality.quality_rules(df, least_rows=100).collect()  # a whole table under least_rows: base rules only
    assert all(x["distance2"] is None and x["kept"] == (not x["base_failed"]) for x in alone)


# ---- 6


def test_levenshtein_automaton_against_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    terms = ["idiot", "moron", "worthless", "scum", "trash"]
    trie = toxicity.Trie(dict.fromkeys(terms, 1.0))
    r = random.Random(3)
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randrange(2)] = r.choice(["", "a", "t", "zz"])
        word = "".join(w)
        want = {t for t in terms if distance(word, t) <= 1}
        assert set(trie.within(word)) == want
        assert trie.near(word) or not want


def test_toxicity_learns_terms_misspellings_and_quotation(spark):
    r = random.Random(1)
    texts, labels = [], []
    for i in range(240):
        words = prose(i, 40).split()
        if i % 4 == 0:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(["grommel", "skallard", "vorpent"])
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    df = docs(spark, texts + EDGE)
    model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.weights) == {"grommel", "skallard", "vorpent"}
    scored = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(df, model).collect()}
    assert len(scored) == 240 + len(EDGE) and all(0 <= s <= 1 for s in scored.values())
    assert all((scored[i] >= 0.7) == bool(y) for i, y in labels) and all(scored[i] < 0.7 for i in range(240, 240 + len(EDGE)))
    plain = prose(500, 20)
    assert model.score(f"{plain} skalard {plain}") > model.score(plain)
    assert model.score(f'{plain} he said "vorpent" {plain}') < model.score(f"{plain} vorpent {plain}")


def test_toxicity_learns_which_windows_quote(spark):
    """Terms stand in toxic texts, and after a word of reporting in clean ones; held-out texts are told apart by the window."""
    r = random.Random(2)

    def text(i, lead):
        words = prose(i, 40).split()
        for _ in range(2):
            at = r.randrange(38)
            words[at : at + 2] = [lead, r.choice(["grommel", "skallard", "vorpent"])]
        return " ".join(words)

    texts = [text(i, "ba") if i % 3 == 0 else text(i, "reported") if i % 72 == 1 else prose(i, 40) for i in range(600)]
    toxic = [int(i % 3 == 0) for i in range(600)]
    df = docs(spark, texts)
    model = toxicity.fit_toxicity(df, spark.createDataFrame([(i, toxic[i]) for i in range(400)], "doc_id long, toxic int"))
    assert {"grommel", "skallard", "vorpent"} <= set(model.weights) and model.context["reported"] < 0
    scored = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(df, model).collect()}
    held = range(400, 600)
    caught = sum(scored[i] >= 0.7 for i in held if toxic[i])
    assert caught >= 0.9 * sum(toxic[i] for i in held) and not any(scored[i] >= 0.7 for i in held if not toxic[i])
    rows = [model.features(t) for t in texts[:400]]
    z = np.array(rows) @ np.array(model.coefficients)
    assert np.allclose([scored[i] for i in range(400)], 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_logistic_reaches_the_minimum():
    r = np.random.default_rng(1)
    x = np.hstack([np.ones((300, 1)), r.random((300, 5))])
    y = (x @ np.array([-2, 4, 1, 0, -1, 2]) + r.standard_normal(300) > 0).astype(float)
    n = r.integers(1, 4, 300).astype(float)
    beta = np.array(toxicity._logistic(x, y, n))
    prior = np.array([-3.0, 8.0, 4.0, 1.0, 0.5, 2.0])

    def loss(b):
        z = x @ b
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.025 * ((b - prior) ** 2).sum())

    assert all(loss(beta) <= loss(beta + d) + 1e-9 for d in 0.01 * r.standard_normal((200, 6)))


def test_toxicity_without_labels(spark):
    df = docs(spark, EDGE)
    none = toxicity.fit_toxicity(docs(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs(spark, []), none).count() == 0
    model = toxicity.fit_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(x["score"] < 0.5 for x in toxicity.score_toxicity(df, model).collect())


# ---- 7


def test_license_templates_and_containment(spark):
    t = licenses.Templates(licenses.TEMPLATES)
    assert min(map(t.collision_probability, t.by_size)) >= 0.9999
    header = licenses.TEMPLATES["Apache-2.0-header"]
    worn = header.replace("agreed", "agrred")
    texts = [*EDGE, prose(1, 50) + " Released under the MIT License. " + prose(2, 50), "x " * 500 + worn + " y" * 300, "Released under the BSD License now", licenses.TEMPLATES["GPL-3.0"] * 1 + " " + prose(3) + " " + licenses.TEMPLATES["GPL-3.0"]]
    got = {x["doc_id"]: x["licenses"] for x in licenses.scan_licenses(docs(spark, texts)).collect()}
    at = len(EDGE)
    assert [m["license"] for m in got[at]] == ["MIT"] and texts[at][got[at][0]["start"] : got[at][0]["end"]] == "Released under the MIT License"
    assert any(m["license"] == "Apache-2.0-header" and m["containment"] >= 0.8 for m in got[at + 1])
    assert got[at + 2] == [] and [m["license"] for m in got[at + 3]] == ["GPL-3.0", "GPL-3.0"]
    assert all(got[i] == [] for i in range(at)) and licenses.scan_licenses(docs(spark, [])).count() == 0


def test_license_places_where_folding_changes_lengths():
    t = licenses.Templates(licenses.TEMPLATES)
    text = "İİİİ Released under the MIT License."
    assert [m[2:] for m in t.scan(text)] == [(5, 35)]
    assert [m[0] for m in t.scan("x " * 300_000 + "RELEASED UNDER THE MIT LICENSE")] == ["MIT"] and t.scan("a" * 1_000_000) == []


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_in_prose(name):
    found = licenses.Templates(licenses.TEMPLATES).scan(f"{prose(3)} {licenses.TEMPLATES[name]} {prose(4)}")
    assert name in {m[0] for m in found}


def test_license_scan_against_every_window():
    t = licenses.Templates({"A": " ".join(f"lic{i}" for i in range(30)), "B": "one two three four five six"})
    r = random.Random(2)
    for _ in range(150):
        words = [f"w{r.randrange(50)}" for _ in range(r.randrange(80))]
        lic = [f"lic{i}" for i in range(30)]
        for _ in range(r.randrange(3)):
            lic[r.randrange(30)] = "gap"
        at = r.randrange(len(words) + 1)
        words[at:at] = lic
        grams = {tuple(f"lic{j}" for j in range(i, i + 5)) for i in range(26)}
        best = max(len({tuple(words[j : j + 5]) for j in range(i, i + 26)} & grams) / 26 for i in range(len(words)))
        assert any(m[0] == "A" for m in t.scan(" ".join(words))) == (best >= 0.8)


@pytest.mark.parametrize("inserted", [0, 12, 20, 30, 40])
def test_license_copies_with_inserted_words(inserted):
    t = licenses.Templates(licenses.TEMPLATES)
    words = licenses.TEMPLATES["MIT-text"].split()
    for shift in range(22):
        copy = " ".join([*words[:24], *(f"i{i}" for i in range(inserted)), *words[24:]])
        text = " ".join(f"p{i}" for i in range(40 + shift)) + f" {copy} " + " ".join(f"q{i}" for i in range(50))
        found = [m for m in t.scan(text) if m[0] == "MIT-text"]
        assert len(found) == 1 and found[0][1] >= 0.9 and found[0][2] == text.index(copy) and copy.startswith(text[found[0][2] : found[0][3]])
        assert [m[0] for m in t.scan(f"{text} {text}")].count("MIT-text") == 2
    assert [m[0] for m in t.scan(f"{copy} {copy}")].count("MIT-text") == 2


# ---- 8


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    r = random.Random(2)
    parts = ["a", "b.", "@", ".", "c-", "com", "1", "23", "255", "256", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+", "+1 (", "555", ")", "é", "0", "\n", "x@y.z", "1.2.3.4", "0001"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(18)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_base_spans_of_very_long_runs_and_zeros():
    assert pii.base_spans("0" * 5000 + "1.1.1.1") == [("ip", 0, 5007)] and pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


@pytest.mark.parametrize("text", ["x" * 1_000_000 + " a1b2", "1" + "x" * 1_000_000, "a1 " * 330_000, "@" * 1_000_000, "x=" * 500_000 + "1", "." * 999_999 + "1", "+1(" * 330_000, "1." * 500_000])
def test_a_million_characters_are_scanned_in_a_few_seconds(text):
    import time

    start = time.process_time()
    found = pii.candidates(text, pii.base_spans(text))
    pii.mask(text, [(k or "other", s, e) for k, s, e, _, _ in found])
    assert time.process_time() - start < 15


def brute_bootstrap(texts, rounds=3, threshold=0.6):
    """The same graph in plain loops: documents to the places found."""
    places = [(i, *c) for i, t in enumerate(texts) for c in pii.candidates(t or "", pii.base_spans(t or ""))]
    seeds = {x[4] for x in places if x[1]}
    seed_edges = {(p, x[4]) for x in places if x[1] for p in x[5]}
    edges = {(p, x[4]) for x in places for p in x[5]}
    known, sure = {}, {}
    for _ in range(rounds):
        of = {}
        for p, i in edges:
            of.setdefault(p, []).append(max(1.0 if (p, i) in seed_edges else 0.0, known.get(i, 0.0)))
        sure = {p: sum(sorted(b)) / (len(b) + pii.DOUBT) for p, b in of.items()}
        sure = {p: c for p, c in sure.items() if c >= threshold}
        known = {}
        for p, i in edges - seed_edges:
            if p in sure:
                known[i] = max(known.get(i, 0.0), sure[p])
    assert seeds or not sure
    out = {}
    for i, kind, start, end, _, patterns in places:
        if kind in (None, pii.SECRET) and any(p in sure for p in patterns):
            out.setdefault(i, set()).add((start, end))
    return out


def planted_identifiers():
    """Texts with seeds, with unseen identifiers in the seeds' contexts, and with like tokens in other contexts."""
    r = random.Random(4)
    lead = ["please call", "reach me via", "contact number"]
    texts = [f"{prose(i, 10)} {lead[i % 3]} +1 (555) 555-{r.randrange(1000, 9999)} {prose(i + 1, 5)}" for i in range(40)]
    texts += [f"{prose(i, 10)} {lead[i % 3]} 0{r.randrange(10**5, 10**6)}-{r.randrange(10**4, 10**5)} {prose(i + 1, 5)}" for i in range(12)]
    texts += [f"{prose(i, 10)} {lead[i % 3]} @handle_{'abc'[i % 3]}{'xyz'[i % 2]} or so" for i in range(6)]
    texts += [f"{prose(i, 10)} see version {r.randrange(1, 9)}.{r.randrange(10, 99)}rc {prose(i + 1, 5)}" for i in range(12)]
    texts += [f"{prose(i, 10)} see version 0{r.randrange(10**5, 10**6)}-{r.randrange(10**4, 10**5)} {prose(i + 1, 5)}" for i in range(12)]
    return texts


def test_bootstrapping_finds_unseen_identifiers_where_a_sure_pattern_stands(spark):
    texts = planted_identifiers()
    df = docs(spark, [*texts, *EDGE, "x" * 300_000 + " 1", *texts[:5]])  # repeated rows, too
    got = {x["doc_id"]: x for x in pii.find_pii(df).collect()}
    n = len(texts)
    assert len(got) == n + len(EDGE) + 6
    found = {i: [tuple(s) for s in x["more"]] for i, x in got.items() if x["more"]}
    assert all(len(got[i]["spans"]) == 1 for i in range(40))
    planted, others = set(range(40, 58)), set(range(58, n))
    assert planted <= set(found) and not others & set(found) and all(len(found[i]) == 1 for i in planted)
    everything = [x["text"] for x in sorted(df.select("doc_id", "text").collect())]
    assert {i: set(x) for i, x in found.items()} == brute_bootstrap(everything)
    masked = {x["doc_id"]: x for x in pii.mask_pii(df).collect()}
    assert "[PHONE]" in masked[0]["text"] and "[OTHER]" in masked[45]["text"] and masked[70]["text"] == texts[70] and masked[n]["text"] is None
    for i, x in masked.items():
        spans = [(k, s, e) for k, s, e in pii.base_spans(everything[i] or "")] + [("other", s, e) for s, e in found.get(i, [])]
        assert x["text"] == pii.mask(everything[i], spans) and x["spans"] == x["fp"] == "x" and x["id"] == 1
    assert pii.find_pii(docs(spark, [])).count() == 0 == pii.mask_pii(docs(spark, [])).count()


def test_a_repeated_text_makes_no_pattern_surer(spark):
    texts = ["one call +1 555 555 1234 now"] * 50 + ["two call ab-1234 now"]
    assert not any(x["more"] for x in pii.find_pii(docs(spark, texts)).collect())


def test_secrets_are_found_by_their_pattern_only(spark):
    r = random.Random(8)
    texts = [f"{prose(i, 6)} key = {r.getrandbits(160):040x} {prose(i + 1, 6)}" for i in range(12)]
    texts += [f"{prose(30, 6)} key = \"k-{r.getrandbits(60)}\"; {prose(31, 6)}", f"{prose(50, 6)} commit {r.getrandbits(160):040x} of {prose(51, 6)}"]
    got = {x["doc_id"]: x["more"] for x in pii.find_pii(docs(spark, texts)).collect()}
    assert all(len(got[i]) == 1 for i in range(13)) and not got[13]


def test_mask_merges_overlaps():
    assert pii.mask("call 12345 now", [("card", 5, 10), ("phone", 5, 8)]) == "call [CARD] now"


# ---- 9


def test_language_of_held_out_texts(spark):
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["schn", "ung", "ver"], "cc": ["eau", "oi", "que"]}
    r, rows = random.Random(0), []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        words = ["".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 3))) for _ in range(40)]
        rows.append((i, " ".join(words), lang if i >= 60 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_margin", F.lit("clash"))
    fitted = langid.fit_dictionaries(df, 20_000)
    assert set(fitted) == {"aa", "bb", "cc"} and fitted == langid.fit_dictionaries(df.repartition(5), 20_000)
    out = langid.identify_languages(df, fitted).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "lang_score", "lang_margin", "lang_rejected"}
    assert langid.identify_languages(df.withColumn("_lang", F.lit(1)).withColumn("Lang_Pred", F.lit(2)), fitted).where("_lang = 1").count() == 240
    assert sum(x["lang_pred"] == ("aa", "bb", "cc")[x["doc_id"] % 3] for x in out if x["doc_id"] < 60) >= 58
    edge = {x["doc_id"]: x for x in langid.identify_languages(docs(spark, EDGE + ["12 !? 3", "²²² ½ Ⅷ"]), fitted).collect()}
    assert len(edge) == len(EDGE) + 2 and all(edge[i]["lang_pred"] == "und" and edge[i]["lang_rejected"] for i in (0, 1, 2, 3, len(EDGE), len(EDGE) + 1))
    assert all(0 <= x["lang_score"] <= 1 for x in edge.values())


def test_language_has_the_least_sum_of_compressed_blocks():
    import zstandard

    data = {k: " ".join(prose(i, 300).split()[::-1] if k == "bb" else prose(i + 5, 300).split()).replace("a", k[0]).encode() for i, k in enumerate(("aa", "bb", "cc"))}
    classifier = langid.CompressionClassifier(data)
    for i, text in enumerate([prose(60, 30), prose(61, 400), prose(62, 5000), "x" * 30_000, "b"]):
        body = " ".join(text.lower().split()).encode()
        level = 6 if len(body) > 512 else 9
        sizes = {}
        for lang, d in data.items():
            c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(body[a : a + 8192])) for a in range(0, len(body), 8192))
        assert classifier.classify(text)[0] == min(sizes, key=sizes.get), i


def test_many_labels_share_the_bytes(spark):
    rows = [(f"l{i % 40}", prose(i, 50)) for i in range(120)]
    fitted = langid.fit_dictionaries(spark.createDataFrame(rows, "lang string, text string"), 20_000, total_bytes=4000)
    assert len(fitted) == 40 and all(0 < len(v) <= 3 * 100 for v in fitted.values())


def test_language_without_labels(spark):
    empty = docs(spark, []).withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit_dictionaries(empty) == {}
    assert [x["lang_pred"] for x in langid.identify_languages(docs(spark, ["some text"]), {}).collect()] == ["und"]


# ---- all


def test_repeated_rows_give_repeated_results(spark):
    """Each operator over every row twice, whole rows and ids too; columns of clashing names are there all along."""
    texts = [*EDGE, prose(1, 60), prose(2, 70), "Released under the MIT License. call +1 555 555 1234"]
    once = docs(spark, texts)
    twice = once.unionByName(once)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(once, labels)
    ratios = resample.fit_log_ratios(once.withColumn("_target", F.lit(True)), 100)
    for operator in (
        simhash.near_duplicates,
        lambda df: resample.importance(df, ratios),
        lambda df: bpe.encode_documents(df, TOKENIZER).select("id", F.md5("ids").alias("ids")),
        lambda df: toxicity.score_toxicity(df, model),
        licenses.scan_licenses,
        lambda df: pii.find_pii(df).select("doc_id", "spans"),
        lambda df: langid.identify_languages(df, {"en": b"some words", "xx": b"other ones"}).select("doc_id", "lang_pred", "lang_score"),
        lambda df: packing.token_pieces(df, TOKENIZER, 512),
    ):
        one, two = (sorted(map(repr, operator(df).collect())) for df in (once, twice))
        assert two == sorted(one * 2) and one
    quality_of = lambda df: quality.quality_rules(df, least_rows=10)
    assert quality_of(twice).count() == 2 * len(texts) and quality_of(twice).distinct().count() == len(texts)
    packed = packing.pack_documents(twice, TOKENIZER, 512).collect()
    assert len(packed) == 2 * packing.token_pieces(once, TOKENIZER, 512).count()
    places = {}
    for x in packed:
        places.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in places.values():
        ends = [o + n for o, n in sorted(own)]
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 512
