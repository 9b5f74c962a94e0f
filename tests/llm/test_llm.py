"""Each operator against plain Python on small rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, chat, common, exact_dedup, fingerprint, langid, near_dedup, packing, pii, quality, queries, repeats, rolling, simhash_dedup
from docloom.operators.iterate import components

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, digest string, fp long, run int, n long, ids int, n_chars long"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, 3, 4, len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


TEXTS = ["a  b\tc", "a b c", None, "", " ", "x" * 50_000, "a b c", "ä Ö\n\nz", "same words here again", "same words here again"]


def test_exact_dedup(spark):
    ids = [7, 3, 5, 9, None, 1, 3, 2, None, None]
    got = exact_dedup.exact_dedup(table(spark, TEXTS, ids), runs=8).collect()
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for t in TEXTS]
    want = Counter()
    for i, t in zip(ids, norm, strict=True):
        group = [j for j, u in zip(ids, norm, strict=True) if u == t]
        want[(i, min((j for j in group if j is not None), default=None), len(group), sha(t))] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({sha(t): 1 for t in norm})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stays = exact_dedup.keep_first(table(spark, TEXTS, ids))
    assert stays.columns == table(spark, TEXTS, ids).columns and stays.count() == len(set(norm))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def classes(values, near):
    parent = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            parent[find(parent, i)] = find(parent, j)
    return [find(parent, i) for i in range(len(values))]


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(250)) for _ in range(6)]
    texts = [*TEXTS, *base, *(b.replace(rng.choice(b.split()), "q", 1) for b in base for _ in range(4)), "Ünder ÄB", "ünder ÄB"]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: r for r in simhash_dedup.near_classes(table(spark, texts, ids)).collect()}
    prints = [plain_simhash(t) for t in texts]
    groups = classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(got) == len(texts)
    for i, p, g in zip(ids, prints, groups, strict=True):
        assert got[i].fingerprint == f"{p:016x}"
        assert got[i].component_id == min(j for j, h in zip(ids, groups, strict=True) if h == g)
    stays = simhash_dedup.keep_one_of_each_class(table(spark, texts, ids))
    assert {r.doc_id for r in stays.collect()} == {r.component_id for r in got.values()}
    assert simhash_dedup.near_classes(table(spark, [])).count() == 0


@pytest.mark.parametrize(("radius", "limit"), [(2, 3), (2, 1000), (1, 2), (0, 5)])
def test_fingerprint_links_lose_no_class(spark, radius, limit):
    rng = np.random.default_rng(radius * 10 + limit)
    made = set()
    for base in rng.integers(0, 1 << 63, 12, dtype=np.uint64):
        for _ in range(25):
            x = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            made.add(x)
    values = sorted(made)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, bucket_limit=limit)
    roots = {r.node: r.root for r in components(links).collect()}
    got, want = {}, {}
    for v, s, g in zip(values, signed, classes(values, lambda a, b: (a ^ b).bit_count() <= radius), strict=True):
        got.setdefault(roots.get(s, s), set()).add(v)
        want.setdefault(g, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def five_word_sets(texts):
    found = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {""})
    return found


def edited(rng, text, edits):
    words = text.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = "q%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.mark.parametrize("few_pairs", [near_dedup.FEW_PAIRS, 0])
def test_near_dedup_is_brute_force_jaccard(spark, monkeypatch, few_pairs):
    monkeypatch.setattr(near_dedup, "FEW_PAIRS", few_pairs)
    rng = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    bases = [" ".join(rng.choice(words) for _ in range(rng.choice([6, 40, 120, 300]))) for _ in range(12)]
    texts = [*TEXTS, *bases, bases[0].upper(), *(edited(rng, b, rng.randint(1, max(1, len(b.split()) // 30))) for b in bases for _ in range(9))]
    sets = five_word_sets(texts)
    groups = classes(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    ids = rng.sample(range(1000), len(texts))
    got = near_dedup.keep_one_of_each_class(table(spark, texts, ids))
    assert got.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(j for j, h in zip(ids, groups, strict=True) if h == g) for g in set(groups))
    assert len(set(groups)) < len(set(classes([plain_simhash(t) for t in texts], lambda a, b: (a ^ b).bit_count() <= 2)))
    assert near_dedup.keep_one_of_each_class(table(spark, [])).count() == 0


@pytest.mark.parametrize("module", [simhash_dedup, near_dedup])
def test_null_and_repeated_ids_lose_no_class(spark, module):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    got = module.keep_one_of_each_class(table(spark, [a, b, c, d, a, c.upper()], [None, None, 7, 7, 3, None])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("3", a), ("None", b), ("7", c), ("7", d)])


def test_pipeline_drops_near_copies_by_jaccard(spark):
    from corpus_pipeline import without_near_copies

    base = " ".join("w%d" % i for i in range(120))
    texts = [base, base.replace("w60 ", "q ").replace("w20 ", "q "), " ".join("w%d" % i for i in range(60, 180))]
    assert (plain_simhash(texts[0]) ^ plain_simhash(texts[1])).bit_count() > 2
    assert {r.doc_id for r in without_near_copies(spark, table(spark, texts), "").collect()} == {0, 2}


def test_pigeonring_budgets():
    for start in range(7):
        masks = simhash_dedup.chain_masks(start)
        assert [b for _, b in masks] == [0, 0, 0, 1, 1, 1, 2] and masks[-1][0] == -1


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100}


FUZZ = ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "é", "ΑΣ", "İ", "ß", "\x1c", " ", "​", "²", "Ⅷ", "漢字", "😀", "-", "a", "zq", "9", " ", "\n", "\x85", "ª", "ɐ", "ﬁ", "K", "﻿", "x" * 90, "\x00"]


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(1)
    texts = [None, "", "word " * 3000, *("".join(rng.choice(FUZZ) for _ in range(rng.randint(0, 14))) for _ in range(400))]
    docs = table(spark, texts)
    lexicon = bpe.build_lexicon(docs, TOKENIZER, size=60)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, TOKENIZER, lexicon), TOKENIZER).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)
    empty = table(spark, [])
    assert bpe.encode(empty, TOKENIZER, bpe.build_lexicon(empty, TOKENIZER)).count() == 0


def test_lexicon_shares_suffixes_and_finds_words():
    entries = {w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(["walking", "talking", "talk", "walk", "é", "été", "s"])}
    lexicon = bpe.Lexicon(bpe.Lexicon.build(entries))
    asked = [*entries, "wal", "walkin", "x", "walkings"]
    numbers = lexicon.numbers([w.encode() for w in asked])
    for word, n in zip(asked, numbers, strict=True):
        assert (lexicon.ids[lexicon.start[n] : lexicon.start[n + 1]].tolist() == entries[word]) if word in entries else n == -1
    assert len(lexicon.accepts) < sum(len(w.encode()) for w in entries)


def test_merge_many_is_merge():
    words = bpe.vocabulary(TOKENIZER)
    rng = random.Random(9)
    some = ["".join(rng.choice("abcdefghijklmnoéß'") for _ in range(rng.randint(1, 90))) for _ in range(300)] + ["a" * 70, "the"]
    ids, sizes = words.merge_many(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [words.merge(w) for w in some]


def test_packing(spark):
    rng = random.Random(2)
    texts = [None, "", *(" ".join(rng.choice(["alpha", "zq", "the"]) for _ in range(rng.randint(0, 900))) for _ in range(40)), "long " * 9000]
    docs = table(spark, texts).repartition(3)
    rows = packing.pack(docs, TOKENIZER, capacity=512, open_windows=3).collect()
    ids = {i: np.append(x, np.uint32(1)) for i, x in enumerate(bpe.merging_encoder(TOKENIZER).encode(texts))}
    by_doc, by_sequence = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and bytes(r.ids) == piece.astype("<u4").tobytes() and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, wanted in [(by_doc[i], len(x)) for i, x in ids.items()] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert wanted in (None, at)
    sizes = [sum(n for _, n in s) for s in by_sequence.values()]
    assert all(n <= 512 and n & (n - 1) == 0 for n in sizes)
    assert packing.pack(table(spark, []), TOKENIZER).count() == 0


def test_pii_is_the_plain_search(spark):
    rng = random.Random(5)
    parts = ["a", "b.", "@", "a@b.c", "1", "23", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "1.2.3.4", "256.", "00", "é", "token = ", "abcd1234efgh", "://", "u:p@h", "IBAN: ", "DE89370400440532013000"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = []
        for kind, pattern in pii.PATTERNS.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                even = sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
                if kind == "email" or (kind == "ip" and all(int(x) < 256 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and even % 10 == 0) or (kind == "phone" and 9 <= len(digits) <= 15):
                    want.append((kind, *m.span()))
        assert [s for s in pii.find(text) if s[0] != "account"] == want
    docs = table(spark, [None, "", "mail é x.y@z.org now", "token = abcd1234efgh", "clean words only"])
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_spans(docs).collect()}
    assert found == {0: [], 1: [], 2: [("email", 7, 16)], 3: [("account", 8, 20)], 4: []}
    clean = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert clean[2][0] == "mail é [EMAIL] now" and clean[2][1] == 18 and clean[4][0] == "clean words only" and clean[0][0] is None
    assert pii.find_spans(table(spark, [])).count() == 0


def test_repeats(spark):
    rng = random.Random(6)
    words = ["alpha", "be", "gamma", "é", "dd", "zeta"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))

    shared = [prose(n) for n in (60, 45, 80)]
    texts = [prose(rng.randint(0, 30)) + rng.choice(shared)[: rng.randint(0, 500)] + prose(rng.randint(0, 15)) for _ in range(30)]
    texts += ["a" * 900, "ab" * 300, "y" * 199, "y" * 200, None, "", texts[3], texts[3], "z" * 150 + shared[0], prose(100_000) + shared[1]]
    near = prose(100)
    texts += [near[:k] + "#" + near[k + 1 :] for k in rng.sample(range(len(near)), 8)]
    counts = Counter(b[i : i + 200] for b in ((t or "").encode() for t in texts) for i in range(len(b) - 199))
    ids = [None if i == 4 else i for i in range(len(texts))]
    got = {r.doc_id: r for r in repeats.remove_repeats(table(spark, texts, ids)).collect()}
    assert len(got) == len(texts)
    for i, text in zip(ids, texts, strict=True):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 199):
            if counts[data[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert bytes(got[i].kept) == np.frombuffer(data, np.uint8)[~gone].tobytes()
        assert sum(s.end - s.start for s in got[i].removed) == gone.sum() and got[i].n_bytes == len(data)
    assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_anchors_stand_for_every_window():
    data = bytes(random.Random(3).randrange(97, 100) for _ in range(1_200_000))
    seen = 0
    for found in rolling.all_anchors([b"short", data], 200, 50):
        assert (found.row == 1).all() and (found.first >= found.last).all() and (found.last >= 0).all() and (found.first <= 150).all()
        seen += int((found.first - found.last + 1).sum())
    assert seen == len(data) - 199


def test_chat_layouts(spark):
    records = [
        (1, 0, '{"messages":[{"role":"system","content":"be"},{"role":"user","content":"<|im_end|>\\n<\\\\|x"},{"role":"assistant","content":null}],"id":4}'),
        (2, 0, '{"prompt":"p","completion":"c"}'),
        (3, 0, '{"instruction":"i","input":"","output":"o","meta":{"prompt":"no"}}'),
        (4, 0, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}'),
        (5, 0, '{"what":1}'),
        (6, 0, "broken"),
        (7, 1, '{"role":"a\\n<|\\\\n","text":"second","turn":1}'),
        (7, 0, '{"role":null,"text":null,"turn":0}'),
        (7, None, '{"role":"user","text":"first","turn":null}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, seq long, j string").withColumn("v", F.try_parse_json("j"))
    back = chat.read_back(chat.format_chats(chat.canonical_turns(df))).collect()
    turns = {}
    for r in sorted(back, key=lambda r: (r.part is not None, r.part or 0)):
        turns.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    assert turns == {
        1: [("system", "be"), ("user", "<|im_end|>\n<\\|x"), ("assistant", "")],
        2: [("user", "p"), ("assistant", "c")],
        3: [("user", "i"), ("assistant", "o")],
        4: [("user", "h"), ("assistant", "g")],
        7: [("user", "first"), ("", ""), ("a\n<|\\n", "second")],
    }
    assert {r.conv_id: r.loss_text for r in back}[4] == "g"
    assert {r.conv_id for r in chat.unknown_layouts(df).collect()} == {5, 6}


def test_fingerprint(spark):
    rng = random.Random(8)
    words = ["word%d" % i for i in range(400)]
    texts = [*TEXTS, "one", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(30))]
    ids = [*rng.sample(range(10_000), len(texts) - 2), 4, 4]
    rows = fingerprint.edited_fingerprints(table(spark, texts, ids)).collect()
    order = sorted(zip(ids, [t or "" for t in texts], strict=True), key=lambda x: (-x[0], x[1]))
    want = Counter()
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text) // 2
        want[(i, len(text), sha(text[: len(text) - half] + after[:half]))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    prints = {}
    for (i, text), r in itertools.product(order, rows):
        if r.doc_id == i and i != 4:
            assert prints.setdefault(text, r.fp) == r.fp
    assert fingerprint.edited_fingerprints(table(spark, [])).count() == 0
    alone = fingerprint.edited_fingerprints(table(spark, ["ab cd"], [None])).collect()
    assert alone[0].edited_sha256 == sha("ab ab")


def test_fingerprint_votes(spark):
    text = "the heavy word the heavy end"
    words = text.split()
    terms = [(f"{a} {b}", 1 + (len(a) > 3) + (len(b) > 3)) for a, b in itertools.pairwise(words)]
    hashed = spark.createDataFrame(list(itertools.pairwise(words)), "a string, b string").select(F.xxhash64("a", "b").alias("h")).collect()
    want = sum(1 << b for b in range(64) if sum(w if r.h >> b & 1 else -w for r, (_, w) in zip(hashed, terms, strict=True)) > 0)
    rows = spark.createDataFrame([(1, text), (2, " ".join([text] * 9000)), (3, "")], "id long, text string")
    got = {r.id: r.fp for r in fingerprint.simhash(rows, ["id"], "text").collect()}
    assert got[1] % (1 << 64) == want and got[3] == 0 and len(got) == 3


def test_fingerprint_search(spark):
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    values += [v ^ (1 << int(b)) ^ (1 << int(c)) for v in values[:20] for b, c in rng.integers(0, 63, (3, 2))] + values[:5]
    got = {(r.fp, r.found): r.n for r in fingerprint.search(spark.createDataFrame([(v,) for v in values[:30]], "fp long"), spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    counts = Counter(values)
    assert got == {(a, b): n for a in set(values[:30]) for b, n in counts.items() if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_quality_learns_and_defines_edges(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(40)) for _ in range(80)]
    bad = [" ".join(rng.choice(["ALPHA!!", "BETA!!"]) for _ in range(40)) for _ in range(80)]
    docs = table(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(rows) == 162 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[i].predicted == int(i < 80) for i in range(160)) and rows[160].score == rows[161].score
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(table(spark, []), nothing).count() == 0


def test_quality_features_do_not_depend_on_blocks():
    texts = ["A b. b! ü", None, "", "x" * 9000, "one two two two", "A b. b! ü"]
    row, feature = quality.features(texts)
    for i, text in enumerate(texts):
        assert feature[row == i].tolist() == quality.features([text])[1].tolist()


def test_language_of_held_out_documents(spark, sf):
    rows = queries.op2_language(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in common.read(spark, sf, "documents").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    model = langid.Model([], np.ones(1 << langid.BITS))
    assert model.predict("abc") == ("und", 0.0)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", None), (4, "hello there", "en"), (5, "hello", "en"), (8, "hello you", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, langid.train(odd)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4] == ("en", 1.0)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in common.read(spark, sf, "labels").collect()}
    held = [r for r in queries.op1_quality(spark, sf).collect() if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95


def test_pipeline(spark, sf):
    docs = common.read(spark, sf, "documents")
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = common.stage(function(spark, docs, sf), "test")
        assert after.columns == docs.columns and after.count() <= docs.count(), name
        docs = after
    kept = docs.collect()
    prints = [plain_simhash(r.text) for r in kept]
    norm = [re.sub(r"[ \t-\r]+", " ", r.text) for r in kept]
    assert len(set(norm)) == len(norm)
    assert not any(s[0] != "account" for r in kept for s in pii.find(r.text))
    assert len({r.doc_id for r in kept}) == len(kept) and len(prints) == len(kept)
    rows = corpus_pipeline.run(spark, sf).collect()
    want = {r.doc_id: len(x) + 1 for r, x in zip(kept, bpe.merging_encoder(TOKENIZER).encode([r.text for r in kept]), strict=True)}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
