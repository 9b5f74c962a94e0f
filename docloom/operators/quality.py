"""Data-quality checks that give issue rows, scores, and the repairs that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X
from docloom.operators.hierarchy import orphans
from docloom.operators.iterate import cut, depths, root_paths
from docloom.operators.rollups import expected_policies
from docloom.operators.simjoin import greedy_leaders, similar_sets, token_sets
from docloom.operators.trees import IS_OUTCOME, with_children
from docloom.staging import stage

# What a good hierarchy keeps to.
MOST_POLICIES, MOST_ROOTS, LEAST_DEPTH, LEAST_COMPLETENESS = 7, 4, 2, 0.80
# Different conditions of a policy up to which they are compared within a row.
FOLDED = 64


def issue(rows: DataFrame, kind: str, severity: str, location: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), location.alias("location"))


def hierarchy_issues(policies: DataFrame, source_refs: DataFrame, jobs: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """Issue rows of policies: fields, sources ``source_refs(policy_id)``, confidence, parents; and of ``jobs(job_id)`` without any policy."""
    where = F.col("policy_id")
    found = (
        issue(policies.where(F.coalesce("title", F.lit("")) == ""), "missing_title", "warning", where)
        .unionByName(issue(policies.where(F.coalesce("description", F.lit("")) == ""), "missing_description", "warning", where))
        .unionByName(issue(policies.join(source_refs.select("policy_id").distinct().hint("merge"), "policy_id", "left_anti"), "missing_source_reference", "error", where))
        .unionByName(issue(policies.where(F.col("confidence") < threshold), "low_confidence", "warning", where))
        .unionByName(issue(orphans(policies), "invalid_parent_reference", "error", where))
    )
    if jobs is None:
        return found
    empty = jobs.select("job_id").join(policies.select("job_id").distinct().hint("merge"), "job_id", "left_anti")
    return found.unionByName(issue(empty, "missing_policies", "error", F.concat(F.lit("job "), F.col("job_id").cast("string"))))


def tree_issues(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """Issue rows of the nodes that a root reaches, and of ``trees(tree_id)`` without a root.

    ``nodes(tree_id, node_id, parent_node_id, sibling_ord, node_type, question_text, outcome_type, has_source)``. A node
    that repeats an id of its path is a circular reference, and nothing below it counts; a node on several paths counts on each.
    """
    where = F.concat_ws("/", F.col("tree_id").cast("string"), F.col("node_id").cast("string"))
    nodes = cut(nodes)
    facts = with_children(nodes).select("tree_id", "node_id", "node_type", "n_children", "question_text", "outcome_type", "has_source").distinct()
    walked = root_paths(nodes, "false")
    rows = cut(walked.where("not cyclic").select("tree_id", "node_id").join(facts.hint("merge"), ["tree_id", "node_id"]))
    rootless = trees.select("tree_id").distinct().join(nodes.where("parent_node_id is null").select("tree_id").distinct(), "tree_id", "left_anti")
    question = F.col("node_type") == "question"
    return (
        issue(rootless, "missing_root_node", "error", F.col("tree_id").cast("string"))
        .unionByName(issue(walked.where("cyclic"), "circular_reference", "error", where))
        .unionByName(issue(rows.where(question & F.col("question_text").isNull()), "missing_question", "error", where))
        .unionByName(issue(rows.where(question & (F.col("n_children") == 0)), "dead_end", "warning", where))
        .unionByName(issue(rows.where(f"{IS_OUTCOME} and outcome_type is null"), "missing_outcome", "error", where))
        .unionByName(issue(rows.where(f"{IS_OUTCOME} and n_children > 0"), "outcome_with_children", "warning", where))
        .unionByName(issue(rows.where(f"{IS_OUTCOME} and not has_source"), "missing_source_reference", "warning", where))
    )


def question_issues(questions: DataFrame) -> DataFrame:
    """Issue rows of ``questions(tree_id, node_id, question_text, explanation)``: very short ones, and those without an explanation."""
    where = F.concat_ws("/", F.col("tree_id").cast("string"), F.col("node_id").cast("string"))
    asked = questions.where("question_text is not null")
    short = issue(asked.where(F.length("question_text") < 10), "short_question", "warning", where)
    return short.unionByName(issue(asked.where(F.coalesce("explanation", F.lit("")) == ""), "missing_explanation", "info", where))


def aggregator_issues(policies: DataFrame, trees: DataFrame) -> DataFrame:
    """Issue rows of ``trees(policy_id, is_aggregator, child_policy_ids, parent_policy_id)`` against the policies that they stand for."""
    kids = policies.where("parent_id is not null").groupBy("job_id", F.col("parent_id").alias("policy_id")).agg(F.collect_set("policy_id").alias("kids"))
    none = F.array().cast("array<string>")
    rows = policies.select("job_id", "policy_id", "parent_id").join(trees.hint("merge"), "policy_id").join(kids.hint("merge"), ["job_id", "policy_id"], "left")
    known = F.coalesce("child_policy_ids", none)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("kids").isNotNull() & ~F.col("is_aggregator"), F.lit("aggregator_metadata_missing")),
            F.when(F.size(F.array_except(F.coalesce("kids", none), known)) > 0, F.lit("missing_child_references")),
            F.when(F.col("kids").isNull() & F.col("is_aggregator"), F.lit("incorrect_aggregator_flag")),
            F.when(F.col("parent_id").isNotNull() & ~F.col("parent_id").eqNullSafe(F.col("parent_policy_id")), F.lit("parent_mismatch")),
        )
    )
    found = rows.select("policy_id", F.explode(kinds).alias("issue_type"))
    severity = F.when(F.col("issue_type") == "aggregator_metadata_missing", "info").otherwise("warning")
    return found.select(severity.alias("severity"), "issue_type", F.col("policy_id").alias("location"))


def recommendations(errors: Column, warnings: Column, completeness: Column, consistency: Column, traceability: Column) -> Column:
    """Array of the rules that hold, in order."""
    return F.array_compact(
        F.array(
            F.when(errors > 0, F.concat(F.lit("Address "), errors.cast("string"), F.lit(" critical errors before using this output"))),
            F.when(warnings > 5, F.concat(F.lit("Review "), warnings.cast("string"), F.lit(" warnings to improve quality"))),
            F.when(completeness < 0.9, F.lit("Some policies are missing decision trees - consider regenerating")),
            F.when(consistency < 0.8, F.lit("Decision trees may not fully represent policy conditions - review for completeness")),
            F.when(traceability < 0.8, F.lit("Improve traceability by adding more source references")),
        )
    )


def retries(needs_retry: Column, retry_count: Column, failed: Column) -> Column:
    """Whether failed trees are tried once more."""
    again = F.coalesce(needs_retry, F.lit(False)) & (F.coalesce(retry_count, F.lit(0)) < 1)
    return F.when(~F.coalesce(failed, F.lit(False)) & again, "retry").otherwise("complete")


def refines(needs_reverification: Column, needs_refinement: Column) -> Column:
    """The step after verification."""
    return F.when(F.coalesce(needs_reverification, F.lit(False)), "reverify").when(F.coalesce(needs_refinement, F.lit(False)), "refine").otherwise("complete")


def completeness(policies: DataFrame, trees: DataFrame) -> DataFrame:
    """Share of policies that have a tree: ``trees(policy_id)``."""
    have = trees.select("policy_id").distinct().withColumn("has_tree", F.lit(True))
    return policies.join(have, "policy_id", "left").groupBy("job_id").agg(F.count_if(F.col("has_tree").isNull()).alias("without_tree"), F.avg(F.col("has_tree").isNotNull().cast("double")).alias("completeness"))


def consistency(policies: DataFrame, conditions: DataFrame, questions: DataFrame) -> DataFrame:
    """Mean of questions by conditions, at most 1, over policies with both: ``questions(policy_id, n_questions)``."""
    counts = conditions.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n_conditions"))
    rows = policies.join(counts, "policy_id").join(questions, "policy_id")
    return rows.groupBy("job_id").agg(F.avg(F.least(F.lit(1.0), F.col("n_questions") / F.col("n_conditions"))).alias("consistency"), F.count_if(F.col("n_questions") < F.col("n_conditions")).alias("incomplete"))


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").pivot("severity", ["error", "warning", "info"]).count().na.fill(0)


def duplicate_policies(policies: DataFrame, conditions: DataFrame) -> DataFrame:
    """(a_id, b_id, title_similarity, condition_similarity, confidence, reason) of duplicates within a parent, null parents being one.

    Rules: titles over 0.95; titles over 0.85 and one level; titles over 0.80 and conditions over 0.80. Policies with equal title
    words are one class: its first is paired with each of the others. Between classes all that counts is titles, levels and
    conditions, so policies that agree in these are one as well: pairs are between their first ones.
    ``policies(job_id, ord, policy_id, parent_id, level, title)``.
    """
    family = F.concat_ws("|", F.col("job_id").cast("string"), F.coalesce(F.col("parent_id").cast("string"), F.lit("-")))
    rows = policies.select(family.alias("g"), F.col("ord").alias("o"), "policy_id", "level", F.array_sort(F.array_distinct(X.without(X.words(F.col("title")), X.VERIFIER_STOP))).alias("t")).where(F.size("t") > 0)
    sets = token_sets(rows)
    between = similar_sets(sets, 0.80).where("similarity > 0.80")
    told = F.array_sort(F.collect_list(F.array_sort(F.array_distinct(X.without(X.words(F.col("description")), X.VERIFIER_STOP)))))
    signs = conditions.groupBy("policy_id").agg(F.xxhash64(told, F.lit(1)).alias("s1"), F.xxhash64(F.lit(2), told).alias("s2"))
    classed = stage(rows.join(sets.select("g", "t", F.col("id").alias("class")), ["g", "t"]).join(signs, "policy_id", "left").drop("t"), "classed")
    order = F.min_by("policy_id", "o").alias("policy_id")
    alike = classed.groupBy("g", "class", "level", "s1", "s2").agg(F.min("o").alias("o"), order).drop("s1", "s2")
    a, b = (alike.select("g", *[F.col(c).alias(f"{c}_{i}") for c in ("class", "level", "o", "policy_id")]) for i in "ab")
    met = between.select("g", F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity").join(a, ["g", "class_a"]).join(b, ["g", "class_b"])
    first = classed.where("o = class").select("g", "class", F.col("policy_id").alias("first_id"), F.col("level").alias("first_level"))
    own = classed.where("o <> class").join(first, ["g", "class"]).select(F.col("first_id").alias("a_id"), F.col("policy_id").alias("b_id"), F.lit(1.0).alias("similarity"), (F.col("first_level") == F.col("level")).alias("same_level"))
    swapped = F.col("o_a") > F.col("o_b")
    others = met.select(F.when(swapped, F.col("policy_id_b")).otherwise(F.col("policy_id_a")).alias("a_id"), F.when(swapped, F.col("policy_id_a")).otherwise(F.col("policy_id_b")).alias("b_id"), "similarity", (F.col("level_a") == F.col("level_b")).alias("same_level"))
    pairs = stage(own.union(others), "title-pairs")
    scored = pairs.join(condition_similarity(pairs.select("a_id", "b_id"), conditions).withColumnRenamed("similarity", "held"), ["a_id", "b_id"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    title, held = F.col("similarity"), F.col("held")
    reason = F.when(title > 0.95, "exact_title_match_same_parent").when((title > 0.85) & F.col("same_level"), "high_title_similarity_same_parent_level").when((title > 0.80) & (held > 0.80), "high_title_and_condition_similarity")
    return scored.withColumn("reason", reason).where("reason is not null").select("a_id", "b_id", title.alias("title_similarity"), held.alias("condition_similarity"), ((title + held) / 2).alias("confidence"), "reason")


def condition_similarity(pairs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Mean over the conditions of A of the best Jaccard similarity to one of B: ``pairs(a_id, b_id)``. A pair of which one has none is left out.

    Equal conditions of a policy count once, with their number as weight, so a pair costs the different ones only. Policies of
    few different ones are compared as arrays, a batch of pairs at a time; only larger ones are joined condition by condition.
    """
    tokens = F.sort_array(F.array_distinct(X.without(X.words(F.col("description")), X.VERIFIER_STOP)))
    sets = stage(conditions.groupBy("policy_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("t")).agg(F.count(F.lit(1)).alias("m")), "condition-sets")
    large = stage(sets.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select("policy_id"), "large-policies")
    listed = sets.join(large, "policy_id", "left_anti").groupBy("policy_id").agg(F.collect_list(F.struct("t", "m")).alias("c"))
    a, b = (listed.select(F.col("policy_id").alias(f"{n}_id"), F.col("c").alias(f"{n}_c")) for n in "ab")
    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in ("a_id", "b_id")] + [T.StructField("similarity", T.DoubleType())])
    few = pairs.select("a_id", "b_id").distinct().join(a, "a_id").join(b, "b_id").mapInArrow(_mean_best, schema)
    if large.isEmpty():
        return few
    some = pairs.select("a_id", "b_id").distinct()
    of_a, of_b = (some.join(large.withColumnRenamed("policy_id", f"{n}_id"), f"{n}_id", "left_semi").select("a_id", "b_id") for n in "ab")
    a, b = (sets.select(F.col("policy_id").alias(f"{n}_id"), F.col("t").alias(f"{n}_t"), F.col("m").alias(f"{n}_m")) for n in "ab")
    best = of_a.union(of_b).distinct().join(a, "a_id").join(b, "b_id").groupBy("a_id", "b_id", "a_t").agg(F.max(X.jaccard(F.col("a_t"), F.col("b_t"))).alias("best"), F.first("a_m").alias("m"))
    return few.union(best.groupBy("a_id", "b_id").agg((F.sum(F.col("best") * F.col("m")) / F.sum("m")).alias("similarity")))


def _mean_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their mean best similarity, from ``a_c`` and ``b_c``, arrays of ``t`` and ``m``."""
    for batch in batches:
        sides = [_parts(batch.column(n)) for n in ("a_c", "b_c")]
        codes = pa.concat_arrays([side[0] for side in sides]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        words_a, words_b = codes[: len(sides[0][0])], codes[len(sides[0][0]) :]
        (_, sizes_a, ends_a, weights, rows_a), (_, sizes_b, ends_b, _, rows_b) = sides
        means = np.empty(batch.num_rows)
        for i in range(batch.num_rows):
            a0, a1, b0, b1 = rows_a[i], rows_a[i + 1], rows_b[i], rows_b[i + 1]
            size_a, size_b = sizes_a[a0:a1], sizes_b[b0:b1]
            vocabulary, place = np.unique(np.concatenate([words_a[ends_a[a0] : ends_a[a1]], words_b[ends_b[b0] : ends_b[b1]]]), return_inverse=True)
            held = np.zeros((a1 - a0 + b1 - b0, len(vocabulary)), np.float32)
            held[np.repeat(np.arange(len(held)), np.concatenate([size_a, size_b])), place] = 1
            common = (held[: a1 - a0] @ held[a1 - a0 :].T).astype(float)
            best = (common / np.maximum(size_a[:, None] + size_b - common, 1)).max(axis=1)
            means[i] = (best * weights[a0:a1]).sum() / weights[a0:a1].sum()
        yield pa.RecordBatch.from_arrays([batch.column("a_id"), batch.column("b_id"), pa.array(means)], ["a_id", "b_id", "similarity"])


def _parts(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of sets: all words, the size of each set, where each begins in the words, its weight, where each list begins in the sets."""
    t, m = column.flatten().flatten()
    sizes = t.value_lengths().to_numpy(zero_copy_only=False)
    lists = column.value_lengths().to_numpy(zero_copy_only=False)
    return t.flatten(), sizes, np.concatenate([[0], sizes.cumsum()]), m.to_numpy(zero_copy_only=False), np.concatenate([[0], lists.cumsum()])


def dedup_conditions(conditions: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(policy_id, ord, condition_id): of a policy's conditions, in order, those not above the threshold similar to one kept before.

    Conditions of equal words are one class of which the first stays if it isn't dropped; those without words all stay. A policy
    of few different conditions is folded as one array; only larger ones are joined. ``ord`` is unique within a policy.
    """
    rows = conditions.where("policy_id is not null and description is not null").select("policy_id", "ord", "condition_id", F.sort_array(F.array_distinct(X.words(F.col("description")))).alias("t"))
    wordless = F.when(F.size("t") == 0, F.col("ord"))
    found = rows.groupBy("policy_id", "t", wordless).agg(F.min("ord").alias("ord"), F.min_by("condition_id", "ord").alias("condition_id"))
    sets = stage(found.select("policy_id", "ord", "condition_id", "t"), "condition-sets")
    large = stage(sets.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select("policy_id"), "large-policies")
    small = sets.join(large, "policy_id", "left_anti").groupBy("policy_id").agg(F.sort_array(F.collect_list(F.struct("ord", "condition_id", "t"))).alias("c"))
    kinds = {f.name: f.dataType for f in sets.schema.fields}
    folded = small.mapInArrow(_unlike(threshold), T.StructType([T.StructField(n, kinds[n]) for n in ("policy_id", "ord", "condition_id")]))
    if large.isEmpty():
        return folded
    rest = stage(sets.join(large, "policy_id", "left_semi"), "large-sets")
    worded = stage(rest.where(F.size("t") > 0).select(F.col("policy_id").alias("g"), F.col("ord").alias("id"), "t", F.size("t").alias("n")), "token-sets")
    pairs = similar_sets(worded, threshold).where(F.col("similarity") > threshold)
    led = greedy_leaders(worded.select("g", F.col("id").alias("o")), pairs, "g", "o").where("leader = o").select(F.col("g").alias("policy_id"), F.col("o").alias("ord"))
    kept = led.union(rest.where(F.size("t") == 0).select("policy_id", "ord"))
    return folded.unionByName(rest.join(kept, ["policy_id", "ord"], "left_semi").select("policy_id", "ord", "condition_id"))


def _unlike(threshold: float):
    """Of each policy's sets ``c``, an array of ``ord``, ``condition_id`` and ``t`` in order, those not above the threshold similar to one kept before."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("c")
            order, ids, t = listed.flatten().flatten()
            sizes = t.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], sizes.cumsum()])
            codes = t.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            counts = listed.value_lengths().to_numpy(zero_copy_only=False)
            stay, at = np.ones(len(sizes), bool), 0
            for n in counts:
                size = sizes[at : at + n]
                vocabulary, place = np.unique(codes[ends[at] : ends[at + n]], return_inverse=True)
                held = np.zeros((n, len(vocabulary)), np.float32)
                held[np.repeat(np.arange(n), size), place] = 1
                # common / (sizes - common) > threshold
                alike = (held @ held.T).astype(float) > threshold * (size[:, None] + size) / (1 + threshold) + 1e-9
                kept = stay[at : at + n]
                for i in np.nonzero(np.tril(alike, -1).any(axis=1))[0]:  # the others have no like before them
                    kept[i] = not (alike[i, :i] & kept[:i]).any()
                at += n
            found = pa.array(np.nonzero(stay)[0])
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts)).take(found)
            yield pa.RecordBatch.from_arrays([batch.column("policy_id").take(rows), order.take(found), ids.take(found)], ["policy_id", "ord", "condition_id"])

    return fold


def survivors(pairs: DataFrame) -> DataFrame:
    """(policy_id, survivor): chains of merges ``pairs(a_id, b_id)`` (a takes b) resolved to their last survivor."""
    first = pairs.groupBy(F.col("b_id").alias("id")).agg(F.min("a_id").alias("up"))
    tops = pairs.select(F.col("a_id").alias("id")).distinct().join(first.select("id"), "id", "left_anti").withColumn("up", F.lit(None).cast("string"))
    found = depths(first.unionByName(tops).withColumn("g", F.lit(0)), "g", "id", "up")
    return found.where("depth > 0").select(F.col("id").alias("policy_id"), F.col("root").alias("survivor"))


def hierarchy_metrics(planned: DataFrame) -> DataFrame:
    """(job_id, issue, severity): too many policies or roots, too shallow below its roots, parents that are absent. ``planned`` as ``hierarchy.plan`` gives it."""
    tops = planned.where("parent_id is null").select("job_id", F.col("policy_id").alias("root"), F.lit(True).alias("true_root"))
    rows = planned.join(tops, ["job_id", "root"], "left")
    deep = F.coalesce(F.max(F.when(F.col("true_root"), F.col("depth"))), F.lit(0))
    orphan = F.col("parent_id").isNotNull() & (F.col("depth") == 0)
    sizes = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parent_id").isNull()).alias("roots"), deep.alias("deepest"), F.count_if(orphan).alias("orphans"))
    tests = {"too_many_policies": ("high", F.col("n") > MOST_POLICIES), "too_many_roots": ("high", F.col("roots") > MOST_ROOTS), "insufficient_depth": ("medium", F.col("deepest") < LEAST_DEPTH), "orphaned_policies": ("low", F.col("orphans") > 0)}
    kinds = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"))) for name, (severity, test) in tests.items()]))
    return sizes.select("job_id", F.inline(kinds))


def tree_completeness(conditions: DataFrame, questions: DataFrame) -> DataFrame:
    """(policy_id, conditions, covered): of each policy with a tree, its conditions and those that a question covers by more than half of their words.

    ``questions(policy_id, question)``; a tree without questions has a row with null. Questions are compared as different word sets.
    """
    words = F.array_sort(F.array_distinct(X.without(X.words(F.col("question")), X.VERIFIER_STOP)))
    asked = questions.groupBy("policy_id").agg(F.collect_set(words).alias("asked"))
    rows = conditions.withColumn("t", F.array_distinct(X.without(X.words(F.col("description")), X.VERIFIER_STOP))).join(asked, "policy_id")
    hit = F.exists("asked", lambda q: F.size(F.array_intersect(q, "t")) / F.greatest(F.size("t"), F.lit(1)) > 0.5)
    return rows.groupBy("policy_id").agg(F.count(F.lit(1)).alias("conditions"), F.count_if(hit).alias("covered"))


def verification(policies: DataFrame, duplicates: DataFrame, coverage: DataFrame, incomplete: DataFrame, metrics: DataFrame, base: DataFrame) -> DataFrame:
    """One row per job: the counts of all checks, confidence, whether it needs refinement, and the step that follows.

    duplicates: a_id, b_id; coverage: job_id, a row per issue; incomplete: policy_id, a row per tree that covers too little;
    metrics: job_id, issue, severity; base: job_id, confidence from validation (0.9 where it has none).
    """
    ids = policies.select("job_id", "policy_id")
    by_job = F.count(F.lit(1))
    dup = duplicates.join(ids.withColumnRenamed("policy_id", "a_id"), "a_id").groupBy("job_id").agg(by_job.alias("duplicate_count"))
    cov = coverage.groupBy("job_id").agg(by_job.alias("coverage_issues"))
    inc = incomplete.join(ids, "policy_id").groupBy("job_id").agg(by_job.alias("tree_issues"))
    cost = F.when(F.col("severity") == "high", 0.10).when(F.col("severity") == "medium", 0.05).otherwise(0.02)
    met = metrics.groupBy("job_id").agg(by_job.alias("hierarchy_issues"), F.count_if(F.col("severity") == "high").alias("high"), F.sum(cost).alias("cost"))
    rows = policies.select("job_id").distinct()
    for part in (dup, cov, inc, met, base.select("job_id", F.col("confidence").alias("base"))):
        rows = rows.join(part, "job_id", "left")
    rows = rows.na.fill(0, ["duplicate_count", "coverage_issues", "tree_issues", "hierarchy_issues", "high", "cost"]).na.fill(0.9, ["base"])
    left = F.col("base") - 0.05 * F.col("duplicate_count") - F.col("cost") - 0.03 * F.col("tree_issues") - 0.02 * F.col("coverage_issues")
    rows = rows.withColumn("confidence", F.round(F.greatest(F.lit(0.0), left), 9))
    needs = (F.col("duplicate_count") > 0) | (F.col("high") > 0) | (F.col("confidence") < 0.95)
    total = sum((F.col(c) for c in ("coverage_issues", "tree_issues", "hierarchy_issues")), F.col("duplicate_count"))
    return rows.select("job_id", total.alias("total_issues"), "duplicate_count", "coverage_issues", "tree_issues", "hierarchy_issues", "confidence", needs.alias("needs_refinement"), (F.col("high") + F.col("duplicate_count")).alias("critical_issues"))


def policy_coverage(chunks: DataFrame, policies: DataFrame) -> DataFrame:
    """Chunks with no policy though some are expected, and with over one and a half times as many: doc_id, chunk_id, issue_type, policy_count, expected_count, policies.

    ``chunks(doc_id, chunk_id, text)``, whose text says how many to expect; ``policies(doc_id, chunk_id, policy_id)``. Only the
    ids of chunks with too many are listed.
    """
    held = policies.groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("policy_count"))
    counted = chunks.select("doc_id", "chunk_id", expected_policies(F.coalesce("text", F.lit(""))).alias("expected_count")).join(held, ["doc_id", "chunk_id"], "left")
    counted = counted.withColumn("policy_count", F.coalesce("policy_count", F.lit(0)))
    issue = F.when(F.col("policy_count") == 0, "missing").when(F.col("policy_count") > 1.5 * F.col("expected_count"), "over_extracted")
    issues = stage(counted.withColumn("issue_type", issue).where("issue_type is not null"), "coverage")
    many = policies.join(issues.where("issue_type = 'over_extracted'").select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")
    listed = many.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list("policy_id")).alias("policies"))
    return issues.join(listed, ["doc_id", "chunk_id"], "left")
