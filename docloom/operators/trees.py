"""Decision trees as flat node tables: counts, paths, reachability, routes, bulk scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.iterate import closure, cut, depths, gathered, path_ways, root_paths

IS_OUTCOME = "node_type = 'outcome'"


def child_counts(nodes: DataFrame) -> DataFrame:
    kids = nodes.where("parent_node_id is not null").groupBy("tree_id", F.col("parent_node_id").alias("node_id"))
    return kids.agg(F.count(F.lit(1)).alias("n_children"), F.array_sort(F.collect_set("answer")).alias("answers"))


def with_children(nodes: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return nodes.join(child_counts(nodes).hint("merge"), ["tree_id", "node_id"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "answers": F.coalesce("answers", none)})


def all_paths(nodes: DataFrame) -> DataFrame:
    """Paths from the root to an outcome or a dead end: tree_id, node_id, path, ords."""
    ends = with_children(nodes).where(f"{IS_OUTCOME} or n_children = 0").select("tree_id", "node_id")
    return root_paths(nodes, IS_OUTCOME).where(~F.col("cyclic")).join(ends, ["tree_id", "node_id"], "left_semi")


def path_ends(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, ways, edges) of outcomes and dead ends: how many paths end there. What ``all_paths`` would list is only counted."""
    ends = with_children(nodes).where(f"{IS_OUTCOME} or n_children = 0").select("tree_id", "node_id").distinct()
    return path_ways(nodes, IS_OUTCOME).join(ends, ["tree_id", "node_id"], "left_semi")


def path_counts(nodes: DataFrame) -> DataFrame:
    """(tree_id, paths, depth): paths to an outcome or a dead end, and the most edges below a root; paths is null for a tree with a cycle above an end.

    Depth counts what is below an outcome too; the second count is made for the trees only that have such nodes.
    """
    nodes = cut(nodes)
    counted = path_ends(nodes).groupBy("tree_id").agg(F.try_sum("ways").alias("paths"), F.bool_or(F.col("ways").isNull()).alias("open"), F.max("edges").alias("depth"))
    counted = counted.select("tree_id", F.when(~F.col("open"), F.col("paths")).alias("paths"), "depth")
    outcomes = nodes.where(IS_OUTCOME).select("tree_id", F.col("node_id").alias("parent_node_id")).distinct()
    deeper = cut(nodes.join(outcomes, ["tree_id", "parent_node_id"], "left_semi").select("tree_id").distinct())
    if deeper.isEmpty():
        return counted
    whole = path_ways(nodes.join(deeper, "tree_id", "left_semi"), "false").groupBy("tree_id").agg(F.max("edges").alias("all_edges"))
    return counted.join(whole, "tree_id", "left").select("tree_id", "paths", F.coalesce("all_edges", "depth").alias("depth"))


def statistics(nodes: DataFrame, rules: DataFrame, confidences: DataFrame) -> DataFrame:
    """One row over all trees: trees, nodes, paths, mean confidence, trees with complete routing. ``confidences(tree_id, confidence)``."""
    nodes = cut(nodes)
    per_tree = report(nodes, rules).join(path_counts(nodes), "tree_id", "left").join(confidences, "tree_id", "left")
    return per_tree.agg(
        F.count(F.lit(1)).alias("trees"), F.sum("nodes").alias("nodes"), F.try_sum("paths").alias("paths"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("incomplete") == 0).alias("complete")
    )


def first_path_to(nodes: DataFrame, outcome: str) -> DataFrame:
    """Per tree the first path, in pre-order, to an outcome of that type; paths go on below other outcomes."""
    hits = nodes.where(F.col("outcome_type") == outcome).select("tree_id", "node_id")
    return root_paths(nodes, "false").where(~F.col("cyclic")).join(hits, ["tree_id", "node_id"], "left_semi").groupBy("tree_id").agg(F.min_by("path", "ords").alias("path"))


def reachable(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(tree_id, node_id) reached from the roots over children and over rules whose target exists.

    Pointer doubling finds all below a root at once, taking one parent of each node; only what other parents and jumps
    lead to outside of that is followed step by step.
    """
    nodes = cut(nodes.select("tree_id", "node_id", "parent_node_id"))
    tops = nodes.where("parent_node_id is null").select("tree_id", F.col("node_id").alias("root")).distinct()
    parent = F.when(F.bool_and(F.col("parent_node_id").isNotNull()), F.min("parent_node_id"))
    chains = depths(nodes.groupBy("tree_id", "node_id").agg(parent.alias("parent_node_id")), "tree_id", "node_id", "parent_node_id")
    below = cut(chains.join(tops, ["tree_id", "root"], "left_semi").select("tree_id", "node_id"))
    jumps = rules.select("tree_id", "node_id", F.col("next_node_id").alias("next")).join(nodes.select("tree_id", F.col("node_id").alias("next")).distinct(), ["tree_id", "next"], "left_semi").select("tree_id", "node_id", "next")
    edges = nodes.where("parent_node_id is not null").select("tree_id", F.col("parent_node_id").alias("node_id"), F.col("node_id").alias("next")).union(jumps)
    hidden = cut(edges.join(below.withColumnRenamed("node_id", "next"), ["tree_id", "next"], "left_anti").select("tree_id", "node_id", "next"))
    entered = hidden.join(below, ["tree_id", "node_id"], "left_semi").select("tree_id", F.col("next").alias("node_id"))
    return below.union(closure(entered, hidden, "tree_id", "node_id"))


def valid_rule() -> Column:
    ranged = F.col("comparison") != "in_range"
    return F.col("next_node_id").isNotNull() & (ranged | F.coalesce(F.col("range_min") <= F.col("range_max"), F.lit(False)))


def incomplete_routes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """A row per missing route of a question: ``no route`` at all, or of yes and no the one that is missing."""
    by_node = rules.groupBy("tree_id", "node_id").agg(F.collect_set("answer_value").alias("routed"))
    rows = with_children(nodes).where("node_type = 'question'").join(by_node, ["tree_id", "node_id"], "left")
    known = F.array_union("answers", F.coalesce("routed", F.array().cast("array<string>")))
    missing = F.when(F.size(known) == 0, F.array(F.lit("no route"))).otherwise(F.array_except(F.array(F.lit("yes"), F.lit("no")), known))
    return rows.select("tree_id", "node_id", F.explode(missing).alias("missing"))


def missing_members(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of logic groups that no node has: ``groups(tree_id, group_id, member_node_ids)``."""
    return groups.select("tree_id", "group_id", F.explode("member_node_ids").alias("node_id")).join(nodes.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")


def report(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Per tree: nodes, questions, outcomes, unreachable nodes, incomplete routes, validity."""
    nodes, rules = cut(nodes), cut(rules)
    sizes = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "question").alias("questions"), F.count_if(F.col("node_type") == "outcome").alias("outcomes"))
    hidden = nodes.select("tree_id", "node_id").join(reachable(nodes, rules), ["tree_id", "node_id"], "left_anti").groupBy("tree_id").agg(F.count(F.lit(1)).alias("unreachable"))
    gaps = incomplete_routes(nodes, rules).groupBy("tree_id").agg(F.count(F.lit(1)).alias("incomplete"))
    out = sizes.join(hidden, "tree_id", "left").join(gaps, "tree_id", "left").na.fill(0)
    return out.withColumn("valid", (F.col("unreachable") == 0) & (F.col("incomplete") == 0))


def outcome_buckets(nodes: DataFrame) -> DataFrame:
    kinds = nodes.select("tree_id", "node_id", "outcome_type")
    return path_ends(nodes).join(kinds.distinct(), ["tree_id", "node_id"]).groupBy("tree_id", F.coalesce("outcome_type", F.lit("other")).alias("bucket")).agg(F.try_sum("ways").alias("paths"))


def score(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """Walk all (subject, tree) pairs at once: ``answers(subject, tree_id, node_id, answer)``.

    A walk ends at an outcome, at a missing answer, at a node it already passed, or where no child has the answer.
    """
    nodes, answers = cut(nodes), cut(answers)
    place = ["subject", "tree_id", "node_id"]
    edges = nodes.where("parent_node_id is not null").select("tree_id", F.col("parent_node_id").alias("node_id"), "answer", F.col("node_id").alias("next"))
    # Inner joins only, whose small side is where the walks are: an outer one would broadcast all answers in each round.
    steps = cut(answers.join(edges, ["tree_id", "node_id", "answer"]).select(*place, "next"))
    roots = nodes.where("parent_node_id is null").select("tree_id", "node_id")
    walks = answers.select("subject", "tree_id").distinct()
    moving = cut(walks.join(roots, "tree_id").select(*place, F.array("node_id").alias("path")))
    passed = F.coalesce(F.array_contains("path", F.col("next")), F.lit(True))
    done: list[DataFrame] = []
    while True:
        stepped = cut(moving.join(steps, place))
        done = gathered(done, moving.join(stepped.select(*place).distinct(), place, "left_anti").union(stepped.where(passed).select(*place, "path")))
        moving = cut(stepped.where(~passed).select("subject", "tree_id", F.col("next").alias("node_id"), F.array_append("path", F.col("next")).alias("path")))
        if moving.isEmpty():
            ends = cut(reduce(DataFrame.unionByName, done))
            kinds = nodes.select("tree_id", "node_id", "outcome_type").join(ends.select("tree_id", "node_id").distinct(), ["tree_id", "node_id"], "left_semi")
            return ends.join(kinds, ["tree_id", "node_id"], "left")


def holds(comparison: Column, value: Column, target: Column, low: Column, high: Column) -> Column:
    """Whether an answer meets a routing rule, for the nine kinds of comparison; an answer that isn't a number meets none of the numeric ones."""
    number, wanted = (c.try_cast("double") for c in (value, target))
    tests = {
        "equals": value == target,
        "not_equals": value != target,
        "greater_than": number > wanted,
        "less_than": number < wanted,
        "greater_equal": number >= wanted,
        "less_equal": number <= wanted,
        "in_range": number.between(low, high),
        "contains": F.contains(value, target),
        "matches_pattern": F.rlike(value, target),
    }
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(comparison == name, F.coalesce(test, F.lit(False))).otherwise(out)
    return out


NODE = "struct<node_id:string,node_type:string,question:struct<question_text:string,question_type:string,options:array<string>>,outcome_type:string,confidence_score:double,children:map<string,string>>"
QUESTION_TYPES = ("yes_no", "multiple_choice", "numeric_range", "text_input", "date", "conditional")


def parse_nodes(trees: DataFrame) -> DataFrame:
    """Nested tree JSON ``trees(tree_id, json)`` as node rows, level by level; children keep the order of their answers.

    An empty or broken node is an outcome ``refer_to_manual`` of confidence 0.3; so is a question without text, which
    keeps its confidence. A node without an id gets its path of answers. Unknown question types are ``yes_no``;
    options count for multiple choice only.
    """
    level = cut(trees.select("tree_id", "json", F.lit(None).cast("string").alias("parent_node_id"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("sibling_ord"), F.lit("root").alias("path")))
    found: list[DataFrame] = []
    while True:
        n = F.from_json("json", NODE)
        read = level.select("*", n.alias("n"))
        empty = F.col("n").isNull() | (F.col("n.node_type").isNull() & F.col("n.question").isNull() & F.col("n.outcome_type").isNull())
        asks = F.coalesce("n.node_type", F.when(F.col("n.question").isNotNull(), "question").otherwise("outcome"))
        silent = (asks == "question") & (F.trim(F.coalesce("n.question.question_text", F.lit(""))) == "")
        is_question = ~empty & (asks == "question") & ~silent
        kind = F.when(F.col("n.question.question_type").isin(*QUESTION_TYPES), F.col("n.question.question_type")).otherwise("yes_no")
        rows = cut(
            read.select(
                "tree_id",
                F.coalesce("n.node_id", "path").alias("node_id"),
                "parent_node_id",
                "answer",
                "sibling_ord",
                F.when(is_question, "question").when(empty | silent, "outcome").otherwise(asks).alias("node_type"),
                F.when(is_question, F.col("n.question.question_text")).alias("question_text"),
                F.when(is_question, kind).alias("question_type"),
                F.when(is_question & (kind == "multiple_choice"), F.col("n.question.options")).alias("options"),
                F.when(~is_question, F.when(empty | silent, "refer_to_manual").otherwise(F.col("n.outcome_type"))).alias("outcome_type"),
                F.when(empty, 0.3).otherwise(F.coalesce("n.confidence_score", F.lit(0.7))).alias("confidence_score"),
                F.when(is_question, F.map_entries("n.children")).alias("kids"),
                "path",
            )
        )
        found = gathered(found, rows.drop("kids", "path"))
        level = rows.select("tree_id", F.col("node_id").alias("parent_node_id"), "path", F.posexplode("kids").alias("sibling_ord", "kid")).select(
            "tree_id", F.col("kid.value").alias("json"), "parent_node_id", F.col("kid.key").alias("answer"), "sibling_ord", F.concat_ws(".", "path", F.col("kid.key")).alias("path")
        )
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def find_nodes(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(tree_id, node_id)`` with ``found`` and the columns of the node: the first in pre-order that a root reaches."""
    walked = root_paths(nodes, "false").where(~F.col("cyclic")).groupBy("tree_id", "node_id").agg(F.min("ords").alias("ords"))
    known = nodes.join(walked.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi").dropDuplicates(["tree_id", "node_id"]).withColumn("found", F.lit(True))
    return asked.join(known, ["tree_id", "node_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
