"""What keeps the figures of large tables in proportion to their input."""

import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.operators import chunks as C
from docloom.operators import classify as K
from docloom.operators import entities as E
from docloom.operators import quality as Q
from docloom.plans import refine_queries as P
from docloom.plans import registry
from docloom.plans.fixtures import spark_fixture
from docloom.staging import stage
from docloom.streaming import jobs as W
from docloom.streaming import state as S


def no_index(*_):
    raise AssertionError("joined by words")


def made_chunks(spark):
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(words), " ".join(words[:19]), " ".join(reversed(words)), "The " + " ".join(words[:18]), "of", "", None, " ".join(words + ["x", "y"])]
    titles = ["Coverage one", "coverage one ", None, "Other thing"]
    rows = [(d, o, o, titles[(o * d) % 4], texts[(o * 7 + d) % 8]) for d, o in itertools.product(range(1, 6), range(1, 12 * 2))]
    return spark.createDataFrame([*rows, (None, 1, 1, "t", texts[0]), (None, 5, 5, "t", texts[0]), (99, 1, 1, None, texts[0]), (99, 2, 2, None, texts[0])], "doc_id long, ord long, start_page long, title string, text string")


def plain_rows(df):
    return sorted((r.doc_id, r.first_chunk, r.chunk, round(r.similarity, 9), r.recommendation) for r in df.collect())


def test_chunks_of_small_documents_are_compared_in_a_row(spark, monkeypatch):
    chunks = made_chunks(spark)
    monkeypatch.setattr(C, "LISTED_CHUNKS", 0, raising=False)
    joined = plain_rows(C.duplicate_chunks(chunks))
    monkeypatch.setattr(C, "LISTED_CHUNKS", 64, raising=False)
    monkeypatch.setattr(C, "similar_sets", no_index)
    assert joined and joined == plain_rows(C.duplicate_chunks(chunks))


@pytest.mark.parametrize("name", ["e01_filtered_chunks"])
def test_filtered_chunks_need_no_index_of_words(spark, sf, monkeypatch, name):
    monkeypatch.setattr(C, "LISTED_CHUNKS", 1000, raising=False)
    monkeypatch.setattr(C, "similar_sets", no_index)
    assert registry.QUERIES[name](spark, sf).count() > 0


def lowered(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("lower(text")


def test_page_scores_lower_a_text_once(spark):
    pages = spark.createDataFrame([(1, 1, 2, "Covered services and definitions", ["Coverage"], 0.9)], "doc_id long, page_number long, pages long, text string, headings array<string>, importance double")
    assert lowered(K.classify_pages(pages)) == 1


def test_document_types_lower_a_text_once_a_step(spark, sf):
    assert lowered(registry.QUERIES["d11_document_type"](spark, sf)) <= 2


class Counted:
    """A state variable that counts the calls to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value if self.value is not None or not isinstance(self, Listed) else []

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.update(None)

    put = update


class Listed(Counted):
    def appendValue(self, value):
        self.update([*(self.value or []), value])

    def appendList(self, values):
        self.calls += len(values) - 1
        self.update([*(self.value or []), *values])


class Handle:
    def __init__(self):
        self.states, self.timers = [], 0

    def _new(self, state):
        self.states.append(state)
        return state

    def getListState(self, *_):
        return self._new(Listed())

    def getValueState(self, *_):
        return self._new(Counted())

    def registerTimer(self, _):
        self.timers += 1

    def getCurrentWatermarkInMs(self):
        return 10**12


@pytest.mark.parametrize("processor", [S.Intervals, S.Progress, S.Lock, S.Trends])
def test_calls_to_the_state_store_do_not_grow_with_a_key(processor):
    handle = Handle()
    stateful = processor()
    stateful.init(handle)
    rows = [Row(us=i * 10**9, event_id=i, kind="start", cpu=1.0, memory=2.0) for i in range(200)]
    stateful.handleInputRows((1,), iter(rows), handle)
    assert len(list(stateful.handleExpiredTimer((1,), handle, None))) == 200
    assert sum(s.calls for s in handle.states) + handle.timers < 15


def test_a_stream_reads_a_table_of_several_files(spark, tmp_path):
    rows = spark.range(10).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01' AS ts")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "file" / "events.parquet")
    for name in ("folder", "file"):
        assert W.finished(W.event_stream(spark, f"{tmp_path}/{name}")).count() == 10


def test_conditions_of_a_policy_are_folded_in_arrow(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "a b c d e f g h i j k l", "", "", "x", "x", None]
    rows = [(f"p{d}", o, f"c{o}", texts[(o * 3 + d) % 8]) for d in range(4) for o in range(1, 17)]
    found = Q.dedup_conditions(spark.createDataFrame(rows, "policy_id string, ord long, condition_id string, description string"), 0.85)
    want = set()
    for policy in {r[0] for r in rows}:
        kept = []
        for _, o, _, text in (r for r in rows if r[0] == policy and r[3] is not None):
            t = set(text.split())
            if not any(t and len(k & t) / len(k | t) > 0.85 for k in kept):
                kept.append(t)
                want.add((policy, o))
    assert {(r.policy_id, r.ord) for r in found.collect()} == want
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_responses_are_parsed_once(spark, sf):
    plan = registry.QUERIES["s16_ingest_response"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_issues_of_policies_are_not_broadcast(spark, sf):
    df = registry.QUERIES["v08_hierarchical_completeness"](spark, sf)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_single_documents_are_not_shuffled(spark, sf):
    for name in ("c19_p34_duplicate_chunks",):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan


def test_duplicates_of_documents_are_those_of_their_pages(spark, monkeypatch):
    lines = [" ".join(f"w{(i * k) % 11}" for i in range(9)) for k in range(1, 8)]
    texts = ["\n".join(lines[(i * d) % 7] for i in range(n)) for d, n in ((1, 40), (2, 31), (3, 5), (4, 6))] + ["", "\n\n\n\n\n", None]
    rows = [(d, t) for d, t in enumerate(texts)] + [(1, texts[0]), (7, texts[1]), (7, texts[1]), (None, texts[0]), (8, "\n".join(lines * 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pages = spark_fixture(spark, "", "doc_pages", {"documents": docs})
    want = plain_rows(C.duplicate_chunks(P.duplicated_chunks(pages)))
    assert plain_rows(P.found_duplicates(docs)) == want and {1, 7, 8, 0} <= {r[0] for r in want}
    monkeypatch.setattr(C, "LISTED_CHARS", 1000, raising=False)
    assert plain_rows(P.found_duplicates(docs)) == want
    types = spark_fixture(spark, "", "page_types", {"doc_pages": pages}).where("doc_id is not null").select("doc_id", "page_number", "primary_type")
    assert sorted(map(tuple, P.page_types_of(docs).select(*types.columns).collect())) == sorted(map(tuple, types.collect()))


def made_policies(spark):
    titles = ["Knee surgery", "knee surgery ", None, None, "Rules of surgery", "surgery rules of today", "Other things", ""]
    rows = [(j, o, f"p{j}_{o}", None if o % 3 else "x", o % 2, titles[o % 8], f"{o % 5} text", (o % 8) / 8) for j, o in itertools.product((1, 2), range(24))]
    return spark.createDataFrame(rows, "job_id long, ord long, policy_id string, parent_id string, level int, title string, description string, confidence double")


def test_policies_are_joined_to_classes_and_none_is_lost(spark, monkeypatch):
    policies = made_policies(spark)

    def both():
        merged, members = E.merge_similar(policies)
        plan = members._jdf.queryExecution().executedPlan().toString()
        return plan, sorted((r.job_id, r.ord, r.leader) for r in members.collect()), sorted(map(repr, merged.select(sorted(merged.columns)).collect()))

    monkeypatch.setattr(E, "BROADCAST_ROWS", 1000, raising=False)
    few = both()
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0, raising=False)
    many = both()
    assert few[1:] == many[1:] and "Broadcast" not in many[0]
    assert [(j, o) for j, o, _ in many[1]] == list(itertools.product((1, 2), range(24)))
    assert all(lead == o for _, o, lead in many[1] if o % 8 in (2, 3))  # no title is like no other


def test_details_of_clusters_are_not_sorted(spark, sf):
    """The only window is that of the conditions' numbers; the policies are hashed, never broadcast by the size of their file."""
    plan = registry.QUERIES["e06_e07_merge_similar"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "strategy=shuffle_hash" in plan


def test_the_first_of_equal_details_stays(spark):
    members = spark.createDataFrame([(1, o, f"p{o}", o - o % 3) for o in range(12)], "job_id long, ord long, policy_id string, leader long")
    rows = [(f"p{(i * 7) % 13}", i, f"c{i % 4}", f"text {i}") for i in range(60)]
    want = {}
    for policy, i, condition, text in sorted(rows, key=lambda r: (int(r[0][1:]), r[1])):
        o = int(policy[1:])
        if o < 12:
            want.setdefault((o - o % 3, condition), (policy, i, text))
    details = spark.createDataFrame(rows, "policy_id string, ord long, condition_id string, text string")
    got = E.group_details(members, details, [F.col("condition_id")]).collect()
    assert {(r.ord, r.condition_id): (r.policy_id, r.detail_ord, r.text) for r in got} == want and len(got) == len(want)


ROOTS = "job_id long, policy_id string, ord int, words array<string>, title_words array<string>, conditions array<string>, page int"


def made_roots(spark, texts, n, pages):
    """(children, umbrellas) of few texts on many policies; words of a text come in any order."""
    rng = random.Random(n)
    held = [tuple(rng.sample([f"w{i}" for i in range(6)] + ["criteria"], k) for k in (rng.randint(1, 4), rng.randint(0, 3), rng.randint(0, 2))) for _ in range(texts)]
    rows = [(1 + i % 2, f"p{i}", i // 2, *[rng.sample(t, len(t)) + ["all"] for t in rng.choice(held)], rng.choice(pages)) for i in range(n)]
    table = spark.createDataFrame(rows, ROOTS)
    return [E.stage(table.where(on), "half") for on in ("ord % 2 = 1", "ord % 2 = 0")]


def every_pair(children, umbrellas):
    ids = children.select("job_id", "policy_id").join(umbrellas.select("job_id", F.col("policy_id").alias("u_policy_id")), "job_id")
    return E.with_both(ids, children, umbrellas)


def ways():
    return [(E.extracted_parents, E.parent_score(), lambda s: s > 0.20), (E.refined_parents, E.refined_score(), lambda s: s >= 0.35)]


def halves(monkeypatch, children, umbrellas):
    """Best parents of these roots, whatever policies and conditions are given."""
    rows = children.withColumn("is_umbrella", F.lit(False)).union(umbrellas.withColumn("is_umbrella", F.lit(True)))
    for scores in ("umbrella_scores", "refined_umbrella_scores"):
        monkeypatch.setattr(E, scores, lambda *_: rows.select("job_id", "policy_id", "is_umbrella"))
    monkeypatch.setattr(E, "with_keywords", lambda *_: rows.drop("is_umbrella"))
    return rows.withColumn("parent_id", F.lit(None).cast("string")), rows.select("policy_id", F.lit("text").alias("description"))


@pytest.mark.parametrize("pages", [[None, 1, 2, 3, 9], [None], [1, 40_000, 40_001, 40_002, 90_000]])
def test_best_parents_of_texts_are_those_of_all_pairs(spark, monkeypatch, pages):
    children, umbrellas = made_roots(spark, 12, 160, pages)
    policies, conditions = halves(monkeypatch, children, umbrellas)
    for parents, score, enough in ways():
        want = sorted(map(tuple, E.best_parents(every_pair(children, umbrellas), score, enough).collect()))
        assert want and want == sorted(map(tuple, parents(policies, conditions, F.col("page")).collect()))


def test_pairs_of_parents_grow_with_texts_not_policies(spark, monkeypatch):
    children, umbrellas = made_roots(spark, 4, 400, [1, 2])
    policies, conditions = halves(monkeypatch, children, umbrellas)
    rows = []

    def counted(df, name, **options):
        table = stage(df, name, **options)
        rows.append(table.count())
        return table

    monkeypatch.setattr(E, "stage", counted)
    for parents, _, _ in ways():
        assert parents(policies, conditions, F.col("page")).count() > 0
    assert max(rows) <= 400  # of 20,000 pairs of children and umbrellas


@pytest.mark.parametrize("name", ["e11_reparent", "r06_best_parent_refined"])
def test_only_conditions_of_roots_are_looked_into(spark, sf, monkeypatch, name):
    policies, conditions = (spark_fixture(spark, sf, f) for f in ("large_jobs", "conditions"))
    roots = {r.policy_id for r in policies.where("parent_id is null").collect()}
    whole, given = E.with_keywords, []

    def seen(policies, conditions, *more):
        given.append({r.policy_id: r.n for r in conditions.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n")).collect()})
        return whole(policies, conditions, *more)

    monkeypatch.setattr(E, "with_keywords", seen)
    registry.QUERIES[name](spark, sf)
    assert given == [{r.policy_id: r.n_conditions for r in E.condition_counts(conditions).collect() if r.policy_id in roots}]


def test_roots_without_conditions_or_with_null_ones_choose_parents(spark):
    rows = [(1, o, f"p{o}", "p0" if o > 6 else None, title, f"{title} of surgery", 1.0) for o, title in enumerate(["knee criteria", "knee criteria", "knee rules", "hip rules", "", "knee rules", "knee rules", "knee rules", None])]
    policies = spark.createDataFrame(rows, "job_id long, ord long, policy_id string, parent_id string, title string, description string, confidence double")
    held = spark.createDataFrame([("p0", 1, "status known"), ("p2", 1, None), ("p2", 2, "status known"), ("p7", 1, "status known"), (None, 1, "status known"), ("p3", 1, None)], "policy_id string, ord long, description string")
    page = F.when(F.col("ord") != 2, F.col("ord") % 3 + 1)
    scores = E.umbrella_scores(policies, E.condition_counts(held), page).select("job_id", "policy_id", "is_umbrella")
    rows = E.with_keywords(policies, held, page).join(scores, ["job_id", "policy_id"])
    want = E.best_parents(every_pair(rows.where("not is_umbrella"), rows.where("is_umbrella")), E.parent_score(), lambda s: s > 0.20)
    got = sorted(map(tuple, E.extracted_parents(policies, held, page).collect()))
    assert got and got == sorted(map(tuple, want.collect()))
