"""Solvers against plain ones, and each operator's defined results: nulls, repeats, ties, long texts, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, chat, common, exact_dedup, fingerprint, langid, near_dedup, packing, pii, quality, queries, repeats, rolling, sampling, simhash_dedup
from tests.llm.test_llm import TOKENIZER, classes, edited, five_word_sets, plain_simhash, sha, table

CLASHING = "doc_id long, text string, __row long, __nth long, __id string, __sha string, __sha256 string, row long, run long, w long, root long, doc string, tag long, fp long, n_chars long"


def clashing(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, 1, "a", "b", "c", 5, 6, 7, 8, "d", 9, 10, len(t or "")) for i, t in zip(ids, texts, strict=True)], CLASHING)


# 1: quality


def test_dual_coordinate_descent_is_the_plain_one_and_optimal():
    rng = np.random.default_rng(1)
    found = [np.sort(rng.choice(30, rng.integers(2, 8), replace=False)) for _ in range(60)]
    ratio = rng.normal(size=30).astype(np.float32)
    scale = np.array([1 / np.sqrt(ratio[f] @ ratio[f]) for f in found], np.float32)
    sign, cost = np.where(rng.random(60) < 0.5, 1.0, -1.0), np.full(60, 0.8)
    got = quality.dual_coordinate_descent(found, ratio, scale, np.arange(60), sign, cost, passes=2000)
    x = np.zeros((60, 31))
    for i, f in enumerate(found):
        x[i, f], x[i, 30] = ratio[f] * scale[i], 1.0
    alpha, order = np.zeros(60), np.random.default_rng(7)
    for _ in range(2000):
        before = alpha.copy()
        for i in order.permutation(np.arange(60)):
            gradient = sign[i] * ((alpha * sign) @ x @ x[i]) - 1
            alpha[i] = min(max(alpha[i] - gradient / (x[i] @ x[i]), 0), cost[i])
        if np.abs(alpha - before).max() < 1e-9:
            break
    assert np.allclose(got, (alpha * sign) @ x, atol=2e-3)
    gradient = sign * (x @ ((alpha * sign) @ x)) - 1  # what is optimal: no step within the bounds helps
    assert all((a > 1e-6 or g > -1e-3) and (a < 0.8 - 1e-6 or g < 1e-3) for a, g in zip(alpha, gradient, strict=True))


def test_ratios_are_log_count_ratios():
    found = [np.array([1, 2]), np.array([2, 3]), np.array([1]), np.array([3, 4])]
    model = quality.Model.fit(found, np.array([1, 1, 0, 0]))
    size = 1 << quality.BITS

    def ratio(feature):
        p, n = (1 + sum(feature in f for f in part) for part in (found[:2], found[2:]))
        return np.log(p / (size + 4)) - np.log(n / (size + 3))

    assert [float(model.square[f]) for f in (1, 2, 3, 4, 9)] == pytest.approx([ratio(f) ** 2 for f in (1, 2, 3, 4, 9)], rel=1e-4, abs=1e-9)


def test_logistic_fit_is_the_least_loss():
    rng = np.random.default_rng(2)
    margin = rng.normal(size=200)
    label = (margin + rng.normal(size=200) > 0).astype(int)
    slope, shift = quality._logistic(margin, label)
    positive = label.sum()
    target = np.where(label == 1, (positive + 1) / (positive + 2), 1 / (200 - positive + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    assert all(loss(slope, shift) <= loss(slope + da, shift + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_long_words_count_whole():
    a, b = "x" * 10_000, "y" + "x" * 9_999
    assert quality.features([a])[1].tolist() != quality.features([b])[1].tolist()
    assert quality.features([a, "k"])[1][: len(quality.features([a])[1])].tolist() == quality.features([a])[1].tolist()


def test_quality_repeats_ties_and_clashes(spark):
    texts = ["good words here"] * 3 + ["BAD!! WORDS!!"] * 3 + [None, "z" * 20_000]
    docs = clashing(spark, texts, [1, 1, 2, 3, 4, 4, None, 9])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, rows=3)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 8 and len({(r.doc_id, r.score) for r in rows if r.doc_id == 1}) == 1 and all(r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.keep_good(docs, model, threshold=0.0).count() == 8 and quality.keep_good(docs, model).columns == docs.columns


def test_samples_are_bounded_and_always_the_same(spark):
    rows = [(i % 500, "a") for i in range(3000)] + [(7, "b")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, label string")
    got = sampling.bounded_sample(df, 60)
    assert len({tuple(r) for r in got.collect()}) == got.count() <= 60
    assert sampling.bounded_sample(df.repartition(7), 60).collect() == got.collect()
    every = sampling.bounded_sample(df, 10_000)
    assert every.count() == 501 and [tuple(r) for r in every.collect()][:40] == [tuple(r) for r in got.collect()][:40]
    assert sampling.bounded_sample(df.limit(0), 5).count() == 0


# 2: language


def test_ftrl_is_the_plain_loop():
    rng = np.random.default_rng(3)
    model, plain = langid.Model(["a", "b", "c"], np.ones(12)), {}
    n = Counter()

    def weight(key):
        z = plain.get(key, 0.0)
        if abs(z) <= langid.L1:
            return 0.0
        return -(z - np.sign(z) * langid.L1) / ((langid.BETA + np.sqrt(n[key])) / langid.ALPHA + langid.L2)

    for _ in range(40):
        at = np.append(np.sort(rng.choice(12, 4, replace=False)), 12)
        value, label = np.append(rng.random(4), 1.0), int(rng.integers(3))
        model.learn(at, value, label)
        w = {(k, f): weight((k, f)) for k in range(3) for f in at}
        score = np.array([sum(w[k, f] * v for f, v in zip(at, value, strict=True)) for k in range(3)])
        p = np.exp(score - score.max())
        p /= p.sum()
        for k in range(3):
            for f, v in zip(at, value, strict=True):
                g = (p[k] - (k == label)) * v
                sigma = (np.sqrt(n[k, f] + g * g) - np.sqrt(n[k, f])) / langid.ALPHA
                plain[k, f] = plain.get((k, f), 0.0) + g - sigma * w[k, f]
                n[k, f] += g * g
    want = [[weight((k, f)) for f in range(13)] for k in range(3)]
    model.finish()
    assert np.allclose(model.weight, want, atol=1e-6)


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(4)
    logits, label = rng.normal(size=(300, 3)) * 6, rng.integers(0, 3, 300)
    logits[np.arange(200), label[:200]] += 5
    model = langid.Model(["a", "b", "c"], np.ones(1))
    model.calibrate(logits, label)

    def loss(t):
        x = logits / t
        return (np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) - (x - x.max(1, keepdims=True))[np.arange(300), label]).mean()

    assert min((loss(t), t) for t in np.exp(np.linspace(-4, 3, 1401)))[1] == pytest.approx(model.temperature, rel=0.02)


def test_language_counts_and_frequencies(spark):
    long = "abc é " * 9000
    small, large = langid.counts(long[:600]), langid.counts(long)
    assert set(small[0]) == set(large[0]) and large[1].sum() == 3 * len(long) - 3
    texts = spark.createDataFrame([("ab",), ("ab",), ("b",), ("",)], "text string")
    frequency, total = langid.document_frequencies(texts)
    b = langid.counts("b")[0]
    assert total == 4 and (frequency[b] == 3).all() and frequency.max() == 3


def test_language_repeats_ties_and_nothing(spark):
    assert langid.identify(table(spark, []), langid.train(table(spark, []))).count() == 0
    rows = [(1, "hello there", "en")] * 3 + [(4, "guten tag ja", "de"), (4, "guten tag", "de"), (None, "hallo du", "de"), (5, "x" * 50_000, "en"), (8, None, "en"), (9, "hi you", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs, rows=4)).collect()
    assert len(got) == len(rows) and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1 and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert langid.Model(["a", "b"], np.ones(1 << langid.BITS))  # ties: the first language
    even = langid.Model(["a", "b"], np.ones(1 << langid.BITS))
    even.finish()
    assert even.predict("word") == ("a", 0.5)


# 3: chat


def test_conversation_digests_of_many_parts(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "a\\n\x00\n<|\\|", "\\s", "human", None, ""]
    rows = [(1, t, rng.choice(roles), rng.choice(["x", "<|im_end|>\n", "<\\|é", None, ""])) for t in range(-70, 200)] + [(1, None, "user", "first"), (2, 3, "assistant", "b"), (2, 3, "assistant", "a"), (2, 3, "assistant", "a"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(c, t, r, x, "extra") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, conv string")
    records = df.select("conv_id", F.col("turn").alias("seq"), F.to_variant_object(F.struct("turn", "role", "text")).alias("v"))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_chats(chat.canonical_turns(records))).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns))
        assert got[conv].loss_chars == len(said) and got[conv].loss_sha256 == sha(said)
    assert chat.conversation_digests(chat.format_chats(chat.canonical_turns(records.limit(0)))).count() == 0


# 4: fingerprints


def test_fingerprint_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["same text here"] * 5 + [None, "", "é" * 3000]
    docs = clashing(spark, texts, range(0, 10 * len(texts), 10))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op4_fingerprint(spark, str(tmp_path)).collect()}
    ids = sorted(rows, reverse=True)
    prints = {i: int(rows[i].fingerprint, 16) for i in ids}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        r = rows[i]
        assert r.near_next == pytest.approx(1 - (prints[i] ^ prints[after]).bit_count() / 64)
        assert r.near_edited == pytest.approx(1 - (prints[i] ^ int(r.edited_fingerprint, 16)).bit_count() / 64)
        assert r.n_within == (sum((prints[i] ^ p).bit_count() <= fingerprint.RADIUS for p in prints.values()) if i % queries.QUERY_STEP == 0 else None)
    many = fingerprint.edited_fingerprints(table(spark, ["a b", "c d", None, "a b"], [None] * 4)).collect()
    assert len(many) == 4 and {r.doc_id for r in many} == {None}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_of_one_id_are_split_and_ids_have_any_type(spark, kind):
    rng = random.Random(9)
    texts = [f"word{rng.randint(0, 40)} of text" for _ in range(300)] + [""] * 200 + ["x" * fingerprint.HEAD + str(i) for i in range(100)] + ["other %d" % i for i in range(40)]
    ids = [None] * 600 + [7 + i // 2 for i in range(40)]
    made = [None if i is None else i if kind == "long" else f"id{i:03d}" for i in ids]
    docs = spark.createDataFrame(list(zip(made, texts, strict=True)), f"doc_id {kind}, text string").repartition(5)
    rows = common.stage(docs.select("doc_id", "text", F.left("text", F.lit(fingerprint.HEAD)).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")), "test")
    placed = fingerprint.in_buckets(rows).collect()
    sizes = Counter(r.bucket for r in placed)
    assert len(sizes) > 10 and max(sizes.values()) < 200 and sum(r.ahead is not None for r in placed) == len(sizes)
    before = sorted(placed, key=lambda r: (r["head"], r["hash"], r["row"]))
    order = sorted((r for r in before if r.doc_id is not None), key=lambda r: r.doc_id, reverse=True) + [r for r in before if r.doc_id is None]
    assert [r.bucket for r in order] == sorted(r.bucket for r in placed)
    want = Counter()
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        half = len(r.text) // 2
        want[(r.doc_id, sha(r.text[: len(r.text) - half] + after.text[:half]))] += 1
    got = fingerprint.edited_fingerprints(docs).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_fingerprint_query_of_text_ids(spark, tmp_path):
    table(spark, ["a b c", "a b c", None], [50, 51, 52]).withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(spark.createDataFrame([("n/a", "a b c"), (None, "")], "doc_id string, text string"), True).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_within for r in queries.op4_fingerprint(spark, str(tmp_path)).collect()} == {"50": 3, "51": None, "52": None, "n/a": None, None: None}


# 5, 9 and the pipeline's near-dedup


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash_dedup.keep_one_of_each_class, near_dedup.keep_one_of_each_class])
def test_clashing_names_and_empty_tables(spark, keep):
    text = " ".join("word%d" % i for i in range(50))
    docs = clashing(spark, [text, text, None, ""], [5, 4, None, 3])
    got = keep(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, ""), (4, text)]
    assert keep(docs.limit(0)).count() == 0


def test_simhash_null_ids(spark):
    got = simhash_dedup.near_classes(clashing(spark, ["a b c", "a b c", "x y z q", None, ""], [None, 8, None, None, None])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.fingerprint) for r in got) == sorted((i, c, f"{plain_simhash(t):016x}") for i, c, t in [(0, 8, "a b c"), (8, 8, "a b c"), (0, 0, "x y z q"), (0, 0, ""), (0, 0, "")])


def test_digest_runs_are_sorted_and_merged(spark):
    rows = common.stage(exact_dedup.digests(spark.createDataFrame([(i, i % 50, f"t{i % 9}") for i in range(400)], "row long, doc_id long, text string")), "test")
    merged = exact_dedup.sorted_runs(rows, 6)
    for bits in (4, 2):
        merged = exact_dedup.merge_round(merged, bits)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [run") >= 2 and "Window" in plan and "HashAggregate" not in plan and "Python" not in plan
    assert sorted((r["first"].doc_id, r.group_size) for r in merged.collect()) == sorted((min(i % 50 for i in range(400) if i % 9 == k), len(range(k, 400, 9))) for k in range(9))


def test_near_dedup_of_long_texts_and_hot_passages(spark):
    rng = random.Random(11)
    words = ["w%d" % i for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    bases = [" ".join(rng.choice(words) for _ in range(n)) for n in (300, 500, 2000, 4000)]
    texts = [b + " " + passage for b in bases] + [passage] + [edited(rng, b + " " + passage, len(b.split()) // 60) for b in bases for _ in range(5)] + [" ".join(rng.choice(words) for _ in range(80)) + " " + passage for _ in range(30)]
    groups = classes(five_word_sets(texts), lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    got = near_dedup.keep_one_of_each_class(clashing(spark, texts))
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(i for i, h in enumerate(groups) if h == g) for g in set(groups))


# 6 and 10: packing and encoding against the library


def test_packed_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(6)
    texts = [None, "", "same text", "same text", "é ß 漢字 don't <|endoftext|>"] + [" ".join(rng.choice(["alpha", "Beta's", "12", "zq-x", "\n"]) for _ in range(rng.randint(1, 700))) for _ in range(30)]
    ids = [None, None, 7, 7, 3, *range(10, 40)]
    rows = packing.pack(clashing(spark, texts, ids).repartition(4), TOKENIZER, capacity=256, open_windows=4).collect()
    want = Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in zip(ids, texts, strict=True))
    got = Counter()
    for i in set(ids):
        pieces = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == i)
        starts = sum(s == 0 for s, _ in pieces)
        if starts == 1:
            got[i, zlib.crc32(b"".join(x for _, x in pieces))] += 1
        else:  # rows that share an id: here each is a single piece
            assert len(pieces) == starts
            for _, x in pieces:
                got[i, zlib.crc32(x)] += 1
    assert got == want and sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)


# 7: personal data


def test_long_secrets_and_cues_in_any_case(spark):
    secret = "ab12" * 75
    login = "u" * 90 + ":" + "p" * 200
    assert pii.find(f"ToKeN = {secret}") == [("account", 8, 8 + 300)]
    assert pii.find(f"see https://{login}@host now") == [("account", 12, 12 + len(login))]
    assert pii.find("IbAN: DE89370400440532013000") == [("account", 6, 28)]
    assert pii.find("iban: " + "DE89" * 2000) == []
    assert pii.find("İİ token = abcd1234")[0][1:] == (11, 19)
    text = "word 12 @ " * 30_000 + "a@b.cc"
    assert pii.find(text) == [("email", len(text) - 6, len(text))]
    docs = clashing(spark, ["a@b.cc", "a@b.cc", None], [1, 1, None])
    assert [len(r.spans) for r in pii.find_spans(docs).orderBy("doc_id").collect()] == [0, 1, 1]
    assert pii.redact(docs).columns == docs.columns


# 8: repeats


def test_identifiers_at_later_offsets_name_bytes():
    rng = random.Random(12)
    data = np.frombuffer(bytes(rng.randrange(97, 99) for _ in range(3000)), np.uint8)
    buckets = rolling.Buckets(data, 5)
    for j in range(3):
        width, level = 5 << j, buckets.level(j)
        assert len(level) == len(data) - width + 1
        named = {}
        for i in range(len(level)):
            assert named.setdefault(data[i : i + width].tobytes(), level[i]) == level[i]
        assert len(set(named.values())) == len(named)
    # A refinement reads the identifiers that the one before has just made, here and at the later offset.
    first, second = buckets.level(0), buckets.level(1)
    assert (second == rolling.mixed(first[:-5] * rolling._PAIR + first[5:])).all()
    start = np.array([0, 7, 100])
    assert buckets.names(start, start + 17).tolist() == buckets.names(start, start + 17).tolist() and len(set(buckets.names(start, start + 17).tolist())) == 3


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeats_of_rows_that_share_an_id(spark, kind):
    rng = random.Random(13)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 300))) + (shared if i % 3 == 0 else "") for i in range(60)] + ["short", "short"]
    ids = [None] * 40 + [7] * 20 + [None, 7]
    docs = spark.createDataFrame([(None if i is None else str(i), t) for i, t in zip(ids, texts, strict=True)], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = Counter((r.doc_id, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect())
    counts = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        gone = {at for k in range(len(t) - 199) if counts[t[k : k + 200]] > 1 for at in range(k, k + 200)}
        want[None if i is None else 7 if kind == "long" else "7", "".join(c for at, c in enumerate(t) if at not in gone).encode()] += 1
    assert got == want


# The pipeline


def test_stages_take_nulls_and_empty_tables(spark, sf):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rng = random.Random(14)
    base = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(200))
    texts = [None, "", base, base, edited(rng, base, 2), "mail x@y.zz now", None]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in zip([None, 1, 2, 3, 4, 5, 5], texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, function in corpus_pipeline.STAGES[1:-1]:
            out = common.stage(function(spark, out, sf), "test")
            assert out.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, out, sf)
        if rows is docs:
            assert sorted(r.doc_id for r in out.collect()) == [1, 2, 5] and {r.doc_id for r in packed.collect()} == {1, 2, 5}
            assert {r.text for r in out.collect()} == {"", base, "mail [EMAIL] now"}
        else:
            assert packed.count() == 0


def test_the_pipeline_keeps_one_of_each_class(spark, sf):
    docs = common.read(spark, sf, "documents")
    first = corpus_pipeline.without_copies(spark, docs, sf)
    held = sorted(first.collect(), key=lambda r: r.doc_id)
    groups = classes(five_word_sets([r.text for r in held]), lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    got = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, first, sf).collect()}
    assert got == {min(held[i].doc_id for i, h in enumerate(groups) if h == g) for g in set(groups)}
    assert len(held) == len({hashlib.sha256(re.sub(r"[ \t-\r]+", " ", r.text).encode()).hexdigest() for r in docs.collect()})


def test_encoding_reads_the_shipped_file(spark, tmp_path):
    import shutil

    copy = tmp_path / "moved_tokenizer.json"
    shutil.copy(TOKENIZER, copy)
    docs = clashing(spark, ["some words", None])
    got = bpe.encode(docs, str(copy), bpe.build_lexicon(docs, str(copy)))
    assert {r.doc_id: len(r.ids) // 4 for r in got.collect()}[1] == 0


def test_packed_ids_keep_all_bits_beside_a_null(spark):
    ids = [(1 << 60) + 1, None, (1 << 62) + 3, None, -(1 << 63)]
    docs = spark.createDataFrame([(i, "some words here", "x") for i in ids], "doc_id long, text string, part string").coalesce(1)
    got = packing.pack(docs, TOKENIZER, with_ids=False)
    assert sorted({r.doc_id for r in got.collect()}, key=str) == sorted(set(ids), key=str)


def test_forms_on_one_template_make_no_pairs(spark, monkeypatch):
    """5,000 forms of a similarity of 0.74, and a near copy of one: all pairs of them would be 12 million."""
    sizes = {}

    def counted(df, name, **options):
        out = common.stage(df, name, **options)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "stage", counted)
    template = " ".join(f"t{i}" for i in range(200))
    texts = [f"{template} " + " ".join(f"v{i}x{j}" for j in range(35)) for i in range(5000)]
    texts.append(texts[7].replace("v7x34", "other"))
    got = near_dedup.keep_one_of_each_class(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(range(5000))
    assert sizes["near-members"] < 1000


def test_samples_are_bounded_in_bytes(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"{'gut' if i % 2 else 'bad'}{rng.randint(0, 300)}" for _ in range(400)), "de" if i % 2 else "en", i % 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    sample = docs.select("doc_id", F.lit(b"x" * 100).alias("found"))
    assert sampling.within_bytes(sample, F.octet_length("found"), ["doc_id"], 1050).count() == 10
    assert sampling.within_bytes(sample, F.octet_length("found"), ["doc_id"]).count() == 120
    assert sampling.within_bytes(sample.limit(0), F.octet_length("found"), ["doc_id"]).count() == 0
    small, whole = quality.train(docs, docs, most_bytes=200_000), quality.train(docs, docs)
    for model in (small, whole):
        good = {r.doc_id: r.predicted for r in quality.score(docs, model).collect()}
        assert sum(good[i] == i % 2 for i in range(120)) > 110
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs, most_bytes=150_000)).collect()}
    assert sum(found[i] == ("de" if i % 2 else "en") for i in range(120)) > 110
    assert quality.train(docs, docs, most_bytes=1).scores(["x"]) == [0.5]
