"""Operators that SQL can't check, and edges: plain Python on small rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import chunking, chunks, entities, hierarchy, iterate, jobs, quality, refine, rollups, simjoin, structure, trees
from docloom.staging import drop, stage, temporary


def plain_words(text):
    return {w for w in re.findall(r"\w+", text.lower())}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_similar_pairs_lose_nothing(spark, threshold):
    rng = random.Random(int(threshold * 10))
    rows = [(g, i, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 7))]) for g in range(2) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, o int, t array<string>")
    got = {(r.g, r.a, r.b): r.similarity for r in simjoin.similar_pairs(df, "g", "o", "t", threshold).collect()}
    first = {}
    for g, o, t in rows:
        if t:
            first.setdefault((g, frozenset(t)), o)
    want = {}
    for g, o, t in rows:
        if t and first[g, frozenset(t)] != o:
            want[g, first[g, frozenset(t)], o] = 1.0
    for (g, s), a in first.items():
        for (h, t), b in first.items():
            if g == h and a < b and len(s & t) / len(s | t) >= threshold:
                want[g, a, b] = len(s & t) / len(s | t)
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_greedy_leaders_are_the_loop(spark):
    rng = random.Random(3)
    pairs = {(rng.randint(0, 1), *sorted(rng.sample(range(25), 2))) for _ in range(60)}
    leaders = {}
    for g in range(2):
        kept = []
        for o in range(25):
            lead = next((k for k in kept if (g, k, o) in pairs), None)
            if lead is None:
                kept.append(o)
            leaders[g, o] = o if lead is None else lead
    rows = spark.createDataFrame([(g, o) for g in range(2) for o in range(25)], "job long, ord long")
    got = simjoin.greedy_leaders(rows, spark.createDataFrame(sorted(pairs), "job long, a long, b long"), "job", "ord")
    assert {(r.job, r.ord): r.leader for r in got.collect()} == leaders


def plain_leaders(rows, links):
    earlier, lead = {}, {}
    for a, b in links:
        earlier.setdefault(b, []).append(a)
    for o in sorted(rows):
        lead[o] = next((a for a in sorted(earlier.get(o, [])) if lead[a] == a), o)
    return lead


def test_contracted_leaders_are_the_loop(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "PLAIN_ROUNDS", 1)
    rng = random.Random(6)
    rows, links = list(range(160)), set()
    for low in range(0, 120, 40):  # sparse, middle and dense parts, near neighbours first
        links |= {(a, b) for a in range(low, low + 40) for b in range(a + 1, min(a + 4 + low // 20, low + 40)) if rng.random() < 0.3 + low / 200}
    links |= {(i, i + 1) for i in range(120, 159)}
    got = simjoin.greedy_leaders(spark.createDataFrame([(0, o) for o in rows], "g long, o long"), spark.createDataFrame([(0, *x) for x in links], "g long, a long, b long"), "g", "o")
    assert {r.o: r.leader for r in got.collect()} == plain_leaders(rows, links)


def test_a_chain_of_20000_takes_a_logarithmic_number_of_rounds(spark, monkeypatch):
    n, cuts = 20_000, []
    plain = simjoin.cut
    monkeypatch.setattr(simjoin, "cut", lambda df: cuts.append(1) or plain(df))
    links = spark.range(n).select(F.lit(0).alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simjoin.greedy_leaders(spark.range(n + 1).select(F.lit(0).alias("g"), F.col("id").alias("o")), links, "g", "o")
    assert got.where("leader <> o - o % 2").count() == 0 and got.count() == n + 1
    assert len(cuts) < 50


def test_depths_of_chains_cycles_and_orphans(spark):
    rows = [("j", f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [("j", "a", "b"), ("j", "b", "a"), ("j", "c", "a"), ("j", "o", "gone")]
    got = {r.id: (r.depth, r.root) for r in iterate.depths(spark.createDataFrame(rows, "g string, id string, up string"), "g", "id", "up").collect()}
    assert got == {f"n{i}": (i, "n0") for i in range(40)} | {x: (None, None) for x in "abc"} | {"o": (0, "o")}
    assert iterate.depths(spark.createDataFrame([], "g string, id string, up string"), "g", "id", "up").count() == 0


def test_page_packing_keeps_every_page_in_order(spark):
    rng = random.Random(5)
    rows = [(d, p, rng.choice([0, 1, 50, 300, 900])) for d in range(8) for p in range(rng.randint(1, 12))]
    got = chunks.packed_pages(spark.createDataFrame(rows, "doc_id long, page_number long, n long"), F.col("n"), 600).collect()
    want = {}
    for d in range(8):
        group, filled = 0, 0
        for _, p, n in sorted(r for r in rows if r[0] == d):
            if filled and filled + n > 600:
                group, filled = group + 1, 0
            filled += n
            want[d, p] = group
    assert {(r.doc_id, r.page_number): r.grp for r in got} == want


def test_char_windows_keep_ids_of_any_type(spark):
    long, text = (1 << 60) + 1, "One sentence. " * 100
    got = chunks.char_windows(spark.createDataFrame([(long, text), (None, text), (5, None), (6, "")], "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.chunk_id) for r in got] == [(long, 0), (long, 1), (None, 0), (None, 1)]
    assert {r.doc_id for r in chunks.char_windows(spark.createDataFrame([("a", text)], "doc_id string, text string")).collect()} == {"a"}


def test_char_windows_cover_the_text(spark):
    rng = random.Random(6)
    texts = ["", None, "x" * 2500, " ".join(rng.choice(["word.", "Next", "some"]) for _ in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_doc = {}
    for r in chunks.char_windows(docs).collect():
        by_doc.setdefault(r.doc_id, []).append((r.start, r.end))
    assert set(by_doc) == {2, 3}
    for d, spans in by_doc.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(texts[d]) and all(0 < b - a <= 1000 for a, b in spans)
        assert all(c <= b < e and c > a for (a, b), (c, e) in zip(spans, spans[1:], strict=False))


def test_titles(spark):
    pairs = [("Medically Necessary Criteria", "Medical Necessity Criteria", False), ("Medically covered items", "Medical coverage item", False), ("Knees surgeries", "knee surgeries", True), ("criteria for surgery coverage", "surgery coverage", True), ("alpha beta", "gamma delta", False), ("", "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", X.title_parts(F.col("a")).alias("pa"), X.title_parts(F.col("b")).alias("pb"))
    assert all(r.got == r.want for r in df.select("want", X.parts_semantically_similar(F.col("pa"), F.col("pb")).alias("got")).collect())


@pytest.mark.parametrize(("similarity", "want"), [(0.9, "REVIEW"), (0.91, "MERGE"), (0.8, "MONITOR"), (0.81, "REVIEW")])
def test_recommendation_edges(spark, similarity, want):
    assert spark.range(1).select(X.merge_recommendation(F.lit(similarity)).alias("r")).first().r == want


def test_json_repair(spark):
    rows = [('{"a":1,}', '{"a":1}'), ('{"a":"True"} // note', '{"a":true}'), ('{"a":{"b":1}} trailing } text', '{"a":{"b":1}}'), ("no braces", "no braces")]
    df = spark.createDataFrame(rows, "c string, want string").select("want", X.balanced_prefix(F.col("c")).alias("got"))
    assert all(r.got.strip() == r.want for r in df.collect())
    parsed = spark.createDataFrame([("```json\n[1,2]\n```",), ('say {"a":1} ok',), ("nothing",)], "c string").select(F.to_json(X.json_value(F.col("c"))).alias("v"))
    assert [r.v for r in parsed.collect()] == ["[1,2]", '{"a":1}', None]


def test_pruning_keeps_active_rows(spark):
    rows = [("g", i, "completed" if i % 3 else "processing") for i in range(13)] + [("h", i, "completed") for i in range(5)]
    got = jobs.pruned(spark.createDataFrame(rows, "grp string, o int, status string"), 5, "grp", "o").collect()
    assert sorted(r.o for r in got if r.grp == "g") == [0, 3, 6, 9, 12] and sum(r.grp == "h" for r in got) == 5


def test_merge_chains_resolve_to_the_last_survivor(spark):
    got = quality.survivors(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a_id string, b_id string")).collect()
    assert {r.policy_id: r.survivor for r in got} == {"b": "a", "c": "a", "y": "x"}


def test_cyclic_trees_end(spark):
    nodes = spark.createDataFrame([(1, 1, None, None, 0, "question", None), (1, 2, 1, "yes", 0, "question", None), (1, 3, 2, "no", 0, "outcome", "ok")], "tree_id long, node_id long, parent_node_id long, answer string, sibling_ord long, node_type string, outcome_type string")
    again = nodes.union(spark.createDataFrame([(1, 2, 3, "back", 1, "question", None)], nodes.schema))
    assert [r.path for r in trees.first_path_to(again, "ok").collect()] == [[1, 2, 3]]


def test_both_merging_passes(spark):
    rows = [("j", 0, "a", None, 0, "Knee surgery", "short", 0.4), ("j", 1, "b", "x", 1, "knee surgery", "much longer text", 0.8), ("j", 2, "c", None, 0, "Other things", "x", 0.5), ("j", 3, "d", None, 0, "Surgery rules of today", "the longest of all texts", 0.5), ("j", 4, "e", None, 0, "rules of surgery", "y", 0.7), ("j", 5, "f", None, 0, "", "", 0.1)]
    policies = spark.createDataFrame(rows, "job_id string, ord long, policy_id string, parent_id string, level int, title string, description string, confidence double")
    merged, leaders = entities.merge_similar(policies)
    got = {r.policy_id: (r.description, round(r.confidence, 6), r.n_merged) for r in merged.collect()}
    assert got == {"a": ("much longer text", 0.6, 2), "c": ("x", 0.5, 1), "d": ("the longest of all texts", 0.6, 2), "f": ("", 0.1, 1)}
    assert {r.ord: r.leader for r in leaders.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}


def test_semantic_titles_lose_nothing(spark):
    rng = random.Random(9)
    words = ["coverage", "criteria", "surgery", "knee", "knees", "medical", "medically", "policy", "for", "adult", "adults", "item"]
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    df = stage(spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "g long, id long, t string").select("g", "id", X.title_parts(F.col("t")).alias("p")), "titles")
    got = {(r.a, r.b) for r in entities.similar_titles(df).collect()}
    x, y = (df.select(F.col("id").alias(i), F.col("p").alias(f"p{i}")) for i in "ab")
    want = {(r.a, r.b) for r in x.join(y, F.col("a") < F.col("b")).where(X.parts_semantically_similar(F.col("pa"), F.col("pb"))).collect()}
    assert got == want and want


def test_long_chains_have_no_cap(spark):
    n = 300
    links = spark.createDataFrame([(0, i, i + 1) for i in range(n)], "g long, a long, b long")
    rows = spark.createDataFrame([(0, i) for i in range(n + 1)], "g long, o long")
    assert {r.o: r.leader for r in simjoin.greedy_leaders(rows, links, "g", "o").collect()} == {i: i - i % 2 for i in range(n + 1)}
    nodes = [(1, i, i - 1 if i else None, 0, "question" if i < n else "outcome", "yes", "end" if i == n else None) for i in range(n + 1)]
    tree = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_node_id long, sibling_ord long, node_type string, answer string, outcome_type string")
    assert [len(r.path) for r in trees.all_paths(tree).collect()] == [n + 1]
    rules = spark.createDataFrame([], "tree_id long, node_id long, next_node_id long")
    assert trees.reachable(tree, rules).count() == n + 1
    assert {r.root for r in iterate.components(links.select("a", "b")).collect()} == {0}


def test_the_index_is_never_broadcast(spark):
    rng = random.Random(4)
    sets = stage(spark.createDataFrame([(1, i, sorted(rng.sample([f"w{k}" for k in range(40)], 8)), 8) for i in range(400)], "g int, id int, t array<string>, n int"), "sets")
    met = simjoin.candidates(simjoin.rare_index(sets, 0.5), simjoin.jaccard_able(0.5))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "CartesianProduct" not in plan


def test_reachable_over_jumps_and_cycles(spark):
    schema = "tree_id long, node_id long, parent_node_id long"
    nodes = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 10, 99), (1, 11, 10), (1, 20, 21), (1, 21, 20), (1, 30, 31), (1, 31, 30), (1, 32, 31)], schema)
    rules = spark.createDataFrame([(1, 2, 10), (1, 11, 21), (1, 20, 77)], "tree_id long, node_id long, next_node_id long")
    assert {r.node_id for r in trees.reachable(nodes, rules).collect()} == {1, 2, 10, 11, 20, 21}


def test_boundary_ranges_are_the_fold(spark):
    rng = random.Random(8)
    rows = [(d, p, [rng.choice(["a", "b", "unassigned"])], rng.random() < 0.3, rng.random() < 0.5, rng.random() < 0.2, f"h{p}") for d in range(30) for p in range(1, 12)]
    want = set()
    for d in range(30):
        held = None
        for _, p, ids, starts, goes_on, ends, _ in [r for r in rows if r[0] == d]:
            if ids == ["unassigned"]:
                continue
            if starts:
                if held:
                    want.add((d, *held))
                held = [ids[0], p, p, False]
            elif held and goes_on:
                held[2:] = [p, True]
            if ends and held:
                held[2] = p
                want.add((d, *held))
                held = None
        if held:
            want.add((d, *held))
    got = chunking.boundary_ranges(spark.createDataFrame(rows, "doc_id long, page_number long, policy_ids array<string>, starts boolean, continues boolean, ends boolean, heading string"))
    assert {(r.doc_id, r.policy_id, r.start_page, r.end_page, r.is_multi_page) for r in got.collect()} == want


def test_conditions_are_deduplicated_as_by_the_fold(spark):
    rng = random.Random(2)
    words = ["one", "two", "three", "four", "five"]
    rows = [(f"p{p}", i, f"c{p}_{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for p in range(6) for i in range(25)]
    want = set()
    for p in range(6):
        kept = []
        for _, _, c, text in [r for r in rows if r[0] == f"p{p}"]:
            t = plain_words(text)
            if not any(t and k and len(t & k) / len(t | k) > 0.6 for k in kept):
                kept.append(t)
                want.add(c)
    got = quality.dedup_conditions(spark.createDataFrame(rows, "policy_id string, ord long, condition_id string, description string"), 0.6)
    assert {r.condition_id for r in got.collect()} == want


@pytest.mark.parametrize("folded", [0, 12, 64])
def test_conditions_of_few_and_many_kinds_agree(spark, monkeypatch, folded):
    rng = random.Random(5)
    rows = [(f"p{p}", i, f"c{p}_{i}", " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 5)))) for p in range(4) for i in range(10 + 8 * p)]
    want = set()
    for p in range(4):
        kept = []
        for _, _, c, text in [r for r in rows if r[0] == f"p{p}"]:
            t = plain_words(text)
            if not any(t and k and len(t & k) / len(t | k) > 0.5 for k in kept):
                kept.append(t)
                want.add(c)
    monkeypatch.setattr(quality, "FOLDED", folded)
    joined = []
    monkeypatch.setattr(quality, "similar_sets", lambda *a: joined.append(a) or simjoin.similar_sets(*a))
    got = quality.dedup_conditions(spark.createDataFrame(rows, "policy_id string, ord long, condition_id string, description string"), 0.5)
    assert {r.condition_id for r in got.collect()} == want
    assert bool(joined) == (folded < 64)


def test_merges_move_children_and_conditions(spark):
    policies = spark.createDataFrame([("j", 0, "a", None, 0, "A", "d", 0.5), ("j", 1, "b", None, 0, "B", "d", 0.5), ("j", 2, "c", "b", 1, "C", "d", 0.5)], "job_id string, ord long, policy_id string, parent_id string, level int, title string, description string, confidence double")
    conditions = spark.createDataFrame([("a", 1, "a1", "x y"), ("b", 1, "b1", "x y"), ("b", 2, "b2", "z"), ("c", 1, "c1", "x y")], "policy_id string, ord long, condition_id string, description string")
    kept, held, taken = refine.merge_duplicates(policies, conditions, spark.createDataFrame([("a", "b")], "a_id string, b_id string"))
    assert {(r.policy_id, r.parent_id) for r in kept.collect()} == {("a", None), ("c", "a")}
    assert {(r.policy_id, r.condition_id) for r in held.collect()} == {("a", "a1"), ("a", "b2"), ("c", "c1")}
    assert [tuple(r) for r in taken.collect()] == [("b", "a")]


def test_headings(spark):
    rows = ["IV. COVERAGE", "2. MEDICAL RULES", "LONG CAPITAL LETTERS", "B. Adult rules", "1.2 Visits", "b. small", "1.2.3 Age", "Billing codes", "National society", "Medical necessity", "Patient selection", "SHORT", "Some title here", "lower case text", "", "CAPITALS WITH 12 NUMBERS"]
    got = {r.text: (r.level, r.numbering, r.title) for r in structure.heading_hierarchy(spark.createDataFrame([(1, i, i, t) for i, t in enumerate(rows)], "doc_id long, page_number long, ord long, text string")).collect()}
    assert got == {
        "IV. COVERAGE": (1, "IV", "COVERAGE"), "2. MEDICAL RULES": (1, "2", "MEDICAL RULES"), "LONG CAPITAL LETTERS": (1, "LONG CAPITAL LETTERS", "LONG CAPITAL LETTERS"), "B. Adult rules": (2, "B", "Adult rules"), "1.2 Visits": (2, "1.2", "Visits"), "b. small": (3, "b", "small"),
        "1.2.3 Age": (3, "1.2.3", "Age"), "Medical necessity": (1, None, "Medical necessity"), "Patient selection": (2, None, "Patient selection"), "Some title here": (2, None, "Some title here"), "lower case text": (2, None, "lower case text"), "": (2, None, ""), "CAPITALS WITH 12 NUMBERS": (1, None, "CAPITALS WITH 12 NUMBERS"),
    }


def test_preorder(spark):
    rows = [("j", 0, "a", None), ("j", 1, "b", "a"), ("j", 2, "c", "a"), ("j", 3, "d", "b"), ("j", 4, "e", None), ("j", 5, "f", "gone")]
    got = hierarchy.flattened(spark.createDataFrame(rows, "job_id string, ord long, policy_id string, parent_id string"))
    assert [r.policy_id for r in got.orderBy("nth").collect()] == ["a", "b", "d", "c", "e"]


def test_chunk_facts_are_those_of_the_text(spark):
    texts = ["", "This means", "shall", "mean see section", "refer to", "x" * 999, "Coverage"]
    rows = spark.createDataFrame([(d, p, (p + d) % 3, texts[(d * 5 + p * 3) % 7]) for d in range(7) for p in range(1, 9)], "doc_id long, page_number long, grp int, text string")
    facts, whole = chunks.chunk_facts(rows, ["doc_id", "grp"]), chunks.joined_text(rows, ["doc_id", "grp"])
    names = ["doc_id", "grp", "start_page", "end_page", "n_pages", "token_count", "has_definitions", "has_complete_context"]
    assert sorted(map(tuple, facts.select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))


def test_staged_tables_go(spark):
    from pathlib import Path

    with temporary() as stay:
        gone, left = stage(spark.range(3), "test"), stage(spark.range(4), "test")
        stay.append(left)
    assert left.count() == 4 and not Path(gone._staged_path.removeprefix("file://")).exists()
    drop(left, spark.range(1))
    assert not Path(left._staged_path.removeprefix("file://")).exists()


# counts of paths

NODES = "tree_id long, node_id long, parent_node_id long, answer string, sibling_ord long, node_type string, outcome_type string"


def stacked_diamonds(tree, n):
    """A root, then per diamond two nodes below one and one below both."""
    rows, top = [(tree, 0, None, None, 0, "question", None)], 0
    for i in range(n):
        left, right, bottom = 3 * i + 1, 3 * i + 2, 3 * i + 3
        kind = "outcome" if i == n - 1 else "question"
        rows += [(tree, left, top, "yes", 0, "question", None), (tree, right, top, "no", 1, "question", None)]
        rows += [(tree, bottom, left, "yes", 0, kind, "ok" if kind == "outcome" else None), (tree, bottom, right, "yes", 0, kind, "ok" if kind == "outcome" else None)]
        top = bottom
    return rows


def test_forty_stacked_diamonds_are_counted(spark):
    nodes = spark.createDataFrame(stacked_diamonds(1, 40) + stacked_diamonds(2, 3) + stacked_diamonds(3, 130), NODES)
    got = {r.tree_id: (r.paths, r.depth) for r in trees.path_counts(nodes).collect()}
    assert got == {1: (2**40, 80), 2: (8, 6), 3: (None, 260)}  # 2 ** 130 has more than 38 digits
    assert {r.tree_id: r.paths for r in trees.outcome_buckets(nodes).collect()}[1] == 2**40


def plain_paths(rows, tree):
    kids, kind = {}, {}
    for t, node, up, _, _, node_type, _ in rows:
        if t == tree:
            kind[node] = node_type
            kids.setdefault(up, []).append(node)

    def count(node):
        return 1 if kind[node] == "outcome" or node not in kids else sum(map(count, kids[node]))

    def depth(node):
        return max((1 + depth(k) for k in kids.get(node, [])), default=0)

    return sum(map(count, dict.fromkeys(kids[None]))), max(map(depth, kids[None]))


def test_paths_of_graphs_are_the_recursion_s(spark):
    rng = random.Random(4)
    rows = []
    for tree in range(6):
        rows.append((tree, 0, None, None, 0, "question", None))
        for node in range(1, 14):
            kind = rng.choice(["question", "question", "outcome"])
            rows += [(tree, node, up, rng.choice("yn"), 0, kind, None) for up in rng.sample(range(node), min(node, rng.randint(1, 3)))]
    rows.append((0, 1, 0, "again", 0, next(r[5] for r in rows if r[:2] == (0, 1)), None))  # a child of two answers counts twice
    got = {r.tree_id: (r.paths, r.depth) for r in trees.path_counts(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {tree: plain_paths(rows, tree) for tree in range(6)}


def test_counts_with_cycles_and_without_nodes(spark):
    rows = [(1, 0, None, None, 0, "question", None), (1, 1, 0, "yes", 0, "question", None), (1, 2, 1, "yes", 0, "question", None), (1, 1, 2, "no", 1, "question", None), (1, 3, 2, "yes", 0, "outcome", "ok"), (2, 0, None, None, 0, "outcome", "ok")]
    assert {r.tree_id: r.paths for r in trees.path_counts(spark.createDataFrame(rows, NODES)).collect()} == {1: None, 2: 1}
    assert trees.path_counts(spark.createDataFrame([], NODES)).count() == 0


# best parents by bounded pairs


def parent_rows(spark, seed, common):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + list(entities.DOMAIN_WORDS)[:3]
    rows = []
    for i in range(90):
        text = rng.sample(words, rng.randint(0, 16)) + ([common] if common else [])
        rows.append((1, f"p{i}", i, text, rng.sample(words[:30], rng.randint(0, 4)), rng.sample(words[:60], rng.randint(0, 6)), rng.choice([None, 1, 1, 2, 3, 9])))
    table = spark.createDataFrame(rows, "job_id long, policy_id string, ord int, words array<string>, title_words array<string>, conditions array<string>, page int")
    return stage(table.where("ord >= 25"), "children"), stage(table.where("ord < 25"), "umbrellas")


@pytest.mark.parametrize("common", [None, "everywhere"])
def test_bounded_pairs_give_the_same_parents(spark, common):
    for seed in (1, 2):
        children, umbrellas = parent_rows(spark, seed, common)
        every = entities.with_both(children.select("job_id", "policy_id").crossJoin(umbrellas.select(F.col("policy_id").alias("u_policy_id"))), children, umbrellas)
        for pairs, score, enough in ((entities.extraction_pairs, entities.parent_score(), lambda s: s > 0.20), (entities.refinement_pairs, entities.refined_score(), lambda s: s >= 0.35)):
            got, want = (sorted(map(tuple, entities.best_parents(found, score, enough).collect())) for found in (pairs(children, umbrellas), every))
            assert got == want and (want or seed)


def test_a_word_that_all_policies_hold_is_no_key(spark):
    children = spark.createDataFrame([(1, f"c{i}", i, [f"own{i}x{j}" for j in range(20)] + ["everywhere"], ["title", f"t{i}", f"u{i}"], [], i) for i in range(200)], "job_id long, policy_id string, ord int, words array<string>, title_words array<string>, conditions array<string>, page int")
    umbrellas = children.withColumn("policy_id", F.concat(F.lit("u"), "policy_id"))
    for pairs in (entities.extraction_pairs, entities.refinement_pairs):
        assert pairs(children, umbrellas).select("policy_id", "u_policy_id").count() == 200  # of 40,000 that share the word


def test_deep_walks_keep_their_plans_small(spark):
    n = 40
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None, "yes", 0, "outcome" if i == n else "question", "end" if i == n else None) for i in range(n + 1)], NODES)
    answers = spark.createDataFrame([(s, 1, i, "yes") for s in range(3) for i in range(n - 15 * s)], "subject long, tree_id long, node_id long, answer string")
    walked = trees.score(nodes, answers)
    assert {(r.subject, r.node_id, r.outcome_type) for r in walked.collect()} == {(0, 40, "end"), (1, 25, None), (2, 10, None)}
    assert walked._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 20


@pytest.mark.parametrize("folded", [0, 4, 64])
def test_condition_similarity_of_few_and_many(spark, monkeypatch, folded):
    rng = random.Random(7)
    rows = [(f"p{p}", " ".join(rng.choice(["one", "two", "three", "four", "five", ""]) for _ in range(rng.randint(0, 4)))) for p in range(5) for _ in range(1 + 2 * p)]
    rows.append(("p1", None))
    held = {p: [plain_words(t or "") for q, t in rows if q == p] for p, _ in rows}
    want = {}
    for a in held:
        for b in held:
            best = [max(len(x & y) / max(len(x | y), 1) for y in held[b]) for x in held[a]]
            want[a, b] = pytest.approx(sum(best) / len(best))
    monkeypatch.setattr(quality, "FOLDED", folded)
    pairs = [(a, b) for a in [*held, "none"] for b in [*held, "none"]]
    joined = []
    monkeypatch.setattr(quality.X, "jaccard", lambda *a, of=X.jaccard: joined.append(a) or of(*a))
    got = quality.condition_similarity(spark.createDataFrame(pairs, "a_id string, b_id string"), spark.createDataFrame(rows, "policy_id string, description string"))
    assert {(r.a_id, r.b_id): r.similarity for r in got.collect()} == want
    assert bool(joined) == (folded < 64)


def test_walks_join_no_answers_from_outside(spark, monkeypatch):
    """A round reads the steps where the walks are; the answers are joined once."""
    rows = [("t", i, i // 2 if i > 1 else None, ["yes", "no"][i % 2], i % 2, "x") for i in range(1, 64)]
    nodes = spark.createDataFrame(rows, "tree_id string, node_id long, parent_node_id long, answer string, sibling_ord int, outcome_type string")
    answers = spark.createDataFrame([(s, "t", i, ["yes", "no"][(i + s) % 2]) for s in (1, 2) for i in range(1, 64)], "subject int, tree_id string, node_id long, answer string")
    outer = []
    monkeypatch.setattr(trees, "cut", lambda df: outer.append("LeftOuter" in df._jdf.queryExecution().analyzed().toString()) or iterate.cut(df))
    want = []
    for s in (1, 2):
        path = [1]
        while path[-1] * 2 < 64:
            path.append(path[-1] * 2 + (path[-1] + s) % 2)
        want.append((s, path))
    assert sorted((r.subject, r.path) for r in trees.score(nodes, answers).collect()) == want
    assert not any(outer)


def test_places_of_a_page_are_counted_without_a_distinct_count(spark):
    rows = [(1, None), *[(1, 10 * (i % 21)) for i in range(50)], *[(2, 100 * (i % 20)) for i in range(50)], (2, None)]
    words = spark.createDataFrame([(page, 612.0, 792.0, "word", x, 100.0) for page, x in rows], "page int, width double, height double, text string, x0 int, top double")
    laid = rollups.page_layout(words)
    assert {r.page: r["columns"] for r in laid.collect()} == {1: 1, 2: 1}
    wide = words.where("page = 2").withColumn("x0", F.when(F.col("x0") == 1900, 5000).otherwise(F.col("x0")))
    more = wide.union(words.where("page = 2").withColumn("x0", F.col("x0") + 1))
    assert [r["columns"] for r in rollups.page_layout(more).collect()] == [21]
    assert "distinct" not in laid._jdf.queryExecution().sparkPlan().toString()
