"""Manifest, vector links and hard negatives against plain Python, with their defined results."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import manifest, negatives, queries, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, word long, pos long, total long, top string"


# 11: manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc, text):
    values = [doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, at):
    for level in levels[:-1]:
        run = at - at % 8
        yield level[run:at], level[at + 1 : run + 8]
        at //= 8


def plain_manifest(docs):
    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees, held = [], []
    for lang in langs:
        rows = sorted(((d["doc_id"] is not None, d["doc_id"] or 0, plain_leaf(d, d["text"])), d) for d in docs if d["lang"] == lang for d in [Doc(d)])
        held.append(rows)
        trees.append(plain_levels([key[2] for key, _ in rows]))
    top = plain_levels([t[-1][0] for t in trees])
    out = []
    for nth, (rows, tree) in enumerate(zip(held, trees, strict=True)):
        for at, (key, d) in enumerate(rows):
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0
            lowered = d["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"])
            cur, proof = plain_leaf(d, lowered if hit else d["text"]), ""
            for left, right in [*beside(tree, at), *beside(top, nth)]:
                cur, proof = sha("".join([*left, cur, *right])), proof + "".join([*left, *right])
            out.append((d["doc_id"], key[2], tree[-1][0], top[-1][0], sha(proof), cur, cur == top[-1][0]))
    return sorted(map(repr, out))


class Doc(dict):
    def __lt__(self, other):
        return False


def manifest_rows(spark, docs):
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], "k", 1, 2, 3, "t") for d in docs], DOCS)
    return sorted(repr(tuple(r)) for r in manifest.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def docs_of(ids, seed=1):
    rng = random.Random(seed)
    return [{"doc_id": i, "text": rng.choice([None, "", "Plain", "lower", "É Ab\n" * 3, "x" * 5000 + "Q"]), "lang": rng.choice([None, "", "de", "en", "é"]), "source": rng.choice([None, "a", "bé"]), "n_chars": rng.choice([None, 3])} for i in ids]


def test_manifest_is_the_plain_one(spark):
    ids = [*range(40), -5, -64, -(1 << 63), (1 << 63) - 1, 1 << 40, (1 << 40) + 63, (1 << 40) + 64]
    docs = docs_of(ids)
    got = manifest_rows(spark, docs)
    assert got == plain_manifest(docs)


def test_manifest_of_a_language_with_several_blocks(spark):
    docs = [{"doc_id": i * 37, "text": f"Text {i}", "lang": "en", "source": None, "n_chars": i} for i in range(1100)]
    assert manifest_rows(spark, docs) == plain_manifest(docs)


def test_manifest_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SPAN", 4)
    docs = docs_of([*range(10), *[None] * 30, *[7] * 20, *[64] * 3], seed=3)
    docs += [dict(docs[12]) for _ in range(11)] + [dict(docs[45]) for _ in range(9)]
    assert manifest_rows(spark, docs) == plain_manifest(docs)


def test_manifest_of_no_rows_and_of_one(spark):
    assert manifest_rows(spark, []) == []
    one = docs_of([4])
    assert manifest_rows(spark, one) == plain_manifest(one)


def test_levels():
    assert [manifest.n_levels(n) for n in (0, 1, 2, 8, 9, 64, 65, 512, 513)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_manifest_gathers_no_more_than_blocks(spark):
    """Nothing but blocks, the directory's bounded windows and ranges of languages is ordered: no sort by document."""
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = manifest.bitmaps(manifest.leaves(docs))._jdf.queryExecution().toString()
    assert "Window" not in plan and "SortAggregate" not in plan


# 12: vector links


def plain_links(vectors, cosine=0.95):
    able = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    width = max((len(v) for v, ok in zip(vectors, able, strict=True) if ok), default=1)
    m = np.array([[*v, *[0.0] * (width - len(v))] if ok else [0.0] * width for v, ok in zip(vectors, able, strict=True)])
    m /= np.where(np.array(able), np.abs(m).max(1, initial=0), 1)[:, None]
    norm = np.where(np.array(able), np.sqrt((m**2).sum(1)), 1)
    linked = (m / norm[:, None]) @ (m / norm[:, None]).T >= cosine
    np.fill_diagonal(linked, False)
    return linked


def plain_classes(ids, vectors):
    linked = plain_links(vectors)
    root = list(range(len(ids)))
    for i in range(len(ids)):
        stack, seen = [i], {i}
        while stack:
            for j in np.flatnonzero(linked[stack.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        root[i] = min((ids[j] for j in seen if ids[j] is not None), default=None)
    return sorted(map(repr, zip(ids, linked.sum(1).tolist(), root, [i == r for i, r in zip(ids, root, strict=True)], strict=True)))


def class_rows(spark, ids, vectors, kind="float"):
    df = spark.createDataFrame([(i, v, 1, 2, "b") for i, v in zip(ids, vectors, strict=True)], f"vec_id long, embedding array<{kind}>, row long, ball long, unit string")
    return sorted(repr(tuple(r)) for r in vector_dedup.vector_classes(df).select("vec_id", "n_links", "component_id", "kept").collect())


def group(rng, size, spread, dims=16):
    centre = rng.normal(size=dims)
    return [np.float32(centre / np.linalg.norm(centre) + rng.normal(size=dims) * s).tolist() for s in rng.uniform(0, spread, size)]


def test_vector_classes_are_the_plain_ones(spark):
    rng = np.random.default_rng(5)
    vectors = [np.float32(rng.normal(size=16)).tolist() for _ in range(150)]
    for size, spread in ((60, 0.03), (60, 0.09), (50, 0.14), (4, 0.05), (2, 0.1), (30, 0.0)):
        vectors += group(rng, size, spread)
    order = rng.permutation(len(vectors))
    vectors = [vectors[i] for i in order]
    ids = rng.permutation(1000)[: len(vectors)].tolist()
    assert class_rows(spark, ids, vectors) == plain_classes(ids, vectors)


def test_vector_edges(spark):
    vectors = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [2.0, 0.0], [1.0, 0.1], [1.0, 0.1], [1e-300, 0.0], [1e300, 1e290], [-1.0]]
    ids = [1, 2, 3, 4, 5, 6, 70, 8, None, 8, 10, 11, None]
    assert class_rows(spark, ids, vectors, "double") == plain_classes(ids, vectors)
    assert class_rows(spark, [], []) == []
    assert class_rows(spark, [3], [None]) == ["(3, 0, 3, True)"]
    assert class_rows(spark, [None, None], [[1.0], [1.0]]) == ["(None, 1, None, True)"] * 2


def test_recall_is_calibrated():
    for n in (500, 50_000, 10**9):
        lines, bands = vector_dedup.calibrated(n)
        assert n * vector_dedup.collision_chance(0.0, lines) <= vector_dedup.PARTNERS
        p = vector_dedup.collision_chance(0.95, lines)
        assert 1 - (1 - p) ** bands - bands * p * (1 - p) ** (bands - 1) >= vector_dedup.RECALL
    assert bands < 50_000**0.5 * 10


def test_collision_chance_is_what_lines_do():
    rng = np.random.default_rng(2)
    lines, hits, tries = vector_dedup.Lines(24, 6, 200), 0, 0
    for _ in range(20):
        x, y = rng.normal(size=(2, 24))
        x /= np.linalg.norm(x)
        y = y - (y @ x) * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y)
        for nth in range(200):
            key, place = lines.band(nth, np.array([x, y]))
            hits += key[0] == key[1] and abs(place[0] - place[1]) <= vector_dedup.HALF
            tries += 1
    assert hits / tries == pytest.approx(vector_dedup.collision_chance(0.95, 6), abs=0.05)


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(150):
        x, y = rng.normal(size=(2, 48))
        x /= np.linalg.norm(x)
        y = y - (y @ x) * x
        cosine = rng.uniform(0.9501, 0.953)
        vectors += [x.tolist(), (cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)).tolist()]
    got = vector_dedup.vector_classes(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).where("n_links > 0").count()
    assert got >= 0.99 * plain_links(vectors).any(1).sum()


def test_a_hot_ball_makes_no_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = group(rng, 1500, 0.01) + [np.float32(rng.normal(size=16)).tolist() for _ in range(100)]
    units = vector_dedup.unit_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"))
    lines, bands = vector_dedup.calibrated(len(vectors))
    found = vector_dedup.balls(units, lines, bands, 0.95)
    assert found.count() == len(vectors) and found.select("ball").distinct().count() < 150
    members = found.join(units, "row")
    assert vector_dedup.colliding_balls(members, lines, bands, 16).count() < 3000


# 13: hard negatives


def plain_negatives(rows, is_anchor):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, label, v) in enumerate(rows):
        if is_anchor(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, same) for nth, (j, same, w) in enumerate(rows) if nth != at)
            for s, j, _ in [x for x in scored if x[2] == label][:5]:
                fit = [(t, k) for t, k, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
                out += [(i, j, nth, k, -s, -t) for nth, (t, k) in enumerate(fit, 1)]
    return sorted(out)


def negative_rows(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, label, v, 7, "x") for i, label, v in rows], f"vec_id long, label int, embedding array<{kind}>, row long, block string")
    found = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_scores_are_inner_products():
    rng = np.random.default_rng(4)
    for low, high in ((-300, 300), (0, 1), (-1, 0), (-(1 << 23), 1 << 23)):
        a, c = rng.integers(low, high + 1, (3, 24)), rng.integers(low, high + 1, (50, 24))
        planes = negatives.bit_planes(c)
        assert planes.dtype == np.uint8 and all((negatives.scores(t, planes) == c @ v).all() for t, v in zip(negatives.tables(a), a, strict=True))


def test_hard_negatives_are_the_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 20)) * 0.2
    rows = [(i, int(rng.integers(4)) if i % 3 else 1, np.float32(centres[int(rng.integers(4))] + rng.normal(size=20) * 0.1).tolist()) for i in range(300)]
    rows += [(300 + i, 2, rows[10][2]) for i in range(5)]  # ties
    monkeypatch.setattr(negatives, "ANCHORS_IN_BLOCK", 7)
    monkeypatch.setattr(negatives, "CANDIDATES_IN_BLOCK", 40)
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    assert len(want) > 100 and negative_rows(spark, rows) == want


def test_negative_edges(spark):
    rows = [(0, 1, [0.5, 0.5]), (5, 1, [0.5]), (10, 1, []), (1, 2, [0.25, 0.3, 0.1]), (2, None, [1.0]), (3, 2, None), (4, 2, [None]), (6, 2, [float("nan")]), (7, 2, [float("inf")]), (None, 1, [1.0]), (8, 3, [0.3, 0.2]), (8, 3, [0.3, 0.2]), (15, 9, [1.0])]
    assert negative_rows(spark, rows) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert negative_rows(spark, []) == [] and negative_rows(spark, [(1, 1, [1.0])]) == []
    assert negative_rows(spark, [(0, 1, [1.0]), (1, 1, [1e5]), (2, 2, [0.7])], "double") == []


def test_new_queries_are_registered():
    assert {"op11_manifest", "op12_vector_dedup", "op13_hard_negatives"} <= set(queries.QUERIES) & set(queries.SQL)
