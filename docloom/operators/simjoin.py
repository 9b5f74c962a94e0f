"""Exact set-similarity self-join by prefix filtering, and greedy clusters over its pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import jaccard
from docloom.operators.iterate import cut
from docloom.staging import drop, stage

PLAIN_ROUNDS = 6


def rare_index(sets: DataFrame, threshold: float) -> DataFrame:
    """(g, w, id, n, rest): each set's rarest tokens, of which a set at the threshold must share one.

    sets: g, id, t (distinct tokens), n (their number). Tokens are ordered by how many sets of the group have them. Of
    two sets at the threshold each has one of its first ``n - ceil(threshold * n) + 1`` tokens in the other; tokens that
    one set has alone count there but can't be shared, so they aren't indexed. rest: how many tokens come after this one.
    """
    grams = sets.select("g", "id", "n", F.explode("t").alias("w"))
    held = stage(grams.groupBy("g", "w").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-tokens")
    shared = grams.join(held, ["g", "w"]).groupBy("g", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    room = (F.size("r") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    first = shared.withColumn("room", room).where("room > 0")
    rows = first.select("g", "id", "n", F.size("r").alias("k"), F.posexplode(F.slice("r", F.lit(1), F.col("room"))).alias("pos", "x"))
    index = stage(rows.select("g", F.col("x.w").alias("w"), "id", "n", (F.col("k") - F.col("pos") - 1).alias("rest")), "rare-tokens")
    drop(held)
    return index


def jaccard_able(threshold: float) -> Column:
    """Whether sizes and remaining tokens allow a Jaccard similarity. The first common token of a pair bounds its overlap."""
    most = F.least("rest_a", "rest_b") + 1
    lengths = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    return lengths & (most * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9)


def larger_able(threshold: float) -> Column:
    """Whether they allow an overlap of that share of the larger set."""
    larger = F.greatest("n_a", "n_b")
    return (F.least("n_a", "n_b") >= threshold * larger - 1e-9) & (F.least("rest_a", "rest_b") + 1 >= threshold * larger - 1e-9)


def candidates(index: DataFrame, able: Column) -> DataFrame:
    """(g, a, b) with a < b: pairs of sets that meet in the index and for which ``able`` holds.

    The index carries ids only and is never broadcast; both sides of the join come straight from a table, so that Spark
    splits a token that very many sets have.
    """
    x, y = (index.select("g", "w", F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("rest").alias(f"rest_{i}")) for i in "ab")
    return x.hint("merge").join(y.hint("merge"), ["g", "w"]).where("a < b").where(able).select("g", "a", "b").distinct()


def contained_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(g, a, b) with a < b: pairs of ``sets(g, id, t, n)`` that may share that part of the smaller set: its rarest tokens meet all of the larger."""
    rare = rare_index(sets, threshold).select("g", "w", F.col("id").alias("x"), F.col("n").alias("n_x"))
    held = stage(sets.select("g", F.explode("t").alias("w"), F.col("id").alias("y"), F.col("n").alias("n_y")), "tokens")
    met = rare.hint("merge").join(held.hint("merge"), ["g", "w"]).where("n_x <= n_y and x <> y")
    return met.select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(g, a, b, similarity) with a < b: all pairs of ``sets(g, id, t, n)`` of a group at the threshold. ``sets`` is a staged table of different sets."""
    found = candidates(rare_index(sets, threshold), jaccard_able(threshold))
    a, b = (sets.select("g", F.col("id").alias(i), F.col("t").alias(f"t_{i}")) for i in "ab")
    return found.join(a, ["g", "a"]).join(b, ["g", "b"]).withColumn("similarity", jaccard(F.col("t_a"), F.col("t_b"))).where(F.col("similarity") >= threshold).select("g", "a", "b", "similarity")


def token_sets(rows: DataFrame) -> DataFrame:
    """(g, id, t, n): the different sets of ``rows(g, o, t)`` under their first ``o``, a staged table; empty sets are left out."""
    sorted_rows = rows.select("g", "o", F.array_sort(F.array_distinct("t")).alias("t")).where(F.size("t") > 0)
    return stage(sorted_rows.groupBy("g", "t").agg(F.min("o").alias("id")).withColumn("n", F.size("t")), "token-sets")


def similar_pairs(rows: DataFrame, group: str, ord_: str, tokens: str, threshold: float) -> DataFrame:
    """(group, a, b, similarity) with a before b: pairs of a group whose Jaccard similarity is at least ``threshold``.

    Rows of equal token sets are one class: pairs are between the first rows of classes, and each first row is paired
    with the others of its class, so copies never give all their pairs. Rows without tokens are in no pair. ``ord_`` is
    unique within a group.
    """
    base = rows.select(F.col(group).alias("g"), F.col(ord_).alias("o"), F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0)
    sets = token_sets(base)
    between = similar_sets(sets, threshold)
    within = base.join(sets.select("g", "t", "id"), ["g", "t"]).where("o <> id").select("g", F.col("id").alias("a"), F.col("o").alias("b"), F.lit(1.0).alias("similarity"))
    return between.union(within).withColumnRenamed("g", group)


def greedy_leaders(rows: DataFrame, pairs: DataFrame, group: str, ord_: str) -> DataFrame:
    """(group, ord, leader): in order, a row joins the first earlier leader that it is similar to, or leads itself.

    Rounds decide all rows whose earlier neighbours are decided. What is open after ``PLAIN_ROUNDS`` are long chains; they
    are contracted, which takes as many rounds as the logarithm of a chain. ``pairs(group, a, b)`` has a before b.
    """
    edges = cut(pairs.select(F.col(group).alias("g"), "a", "b").distinct())
    state = cut(rows.select(F.col(group).alias("g"), F.col(ord_).alias("o"), F.lit(None).cast("long").alias("leader")))
    rounds = 0
    while not state.where("leader is null").isEmpty():
        rounds += 1
        decided = _round(state, edges) if rounds < PLAIN_ROUNDS else _contracted(state, edges)
        after = cut(state.join(decided, ["g", "o"], "left").select("g", "o", F.coalesce("leader", "decided").alias("leader")))
        drop(state)
        state = after
    return state.select(F.col("g").alias(group), F.col("o").alias(ord_), "leader")


def _round(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, o, decided) of the open rows that their earlier neighbours decide: as soon as none that is open comes before the first leader."""
    earlier = edges.join(state.select("g", F.col("o").alias("a"), F.col("leader").alias("lead_a")), ["g", "a"]).groupBy("g", F.col("b").alias("o"))
    seen = earlier.agg(F.min(F.when(F.col("lead_a") == F.col("a"), F.col("a"))).alias("first_leader"), F.min(F.when(F.col("lead_a").isNull(), F.col("a"))).alias("first_open"))
    leader, opened = F.col("first_leader"), F.col("first_open")
    decided = F.when(leader.isNotNull() & (opened.isNull() | (opened > leader)), leader).when(leader.isNull() & opened.isNull(), F.col("o"))
    return state.where("leader is null").join(seen, ["g", "o"], "left").select("g", "o", decided.alias("decided"))


def _contracted(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, o, decided) of all open rows.

    A row leads unless an earlier neighbour does. One whose earlier neighbours all hang on one row leads exactly if that
    one does, or exactly if it doesn't, so it points there with that parity; pointers are doubled. One that would have to
    follow both a row and its opposite doesn't lead. Only rows that hang on several are left for the next round.
    """
    opened = state.where("leader is null").select("g", "o")
    known = edges.join(state.select("g", F.col("o").alias("a"), F.col("leader").alias("lead_a")), ["g", "a"]).join(opened.withColumnRenamed("o", "b"), ["g", "b"])
    links = cut(known.where("lead_a is null or lead_a = a").select("g", "a", "b", F.col("lead_a").isNotNull().alias("leads")))
    beaten = links.groupBy("g", F.col("b").alias("o")).agg(F.bool_or("leads").alias("beaten"))
    node = cut(opened.join(beaten, ["g", "o"], "left").select("g", "o", F.when(F.col("beaten"), F.lit(False)).alias("value"), F.col("o").alias("up"), F.lit(0).alias("flip")))
    left = links.where("not leads").select("g", "a", "b")
    while not node.where("value is null").isEmpty():
        waiting = node.where("value is null and up = o").select("g", F.col("o").alias("b"))
        left = cut(left.join(waiting, ["g", "b"], "left_semi"))
        met = left.join(node.withColumnRenamed("o", "a"), ["g", "a"])
        by_root = met.groupBy("g", "b", F.when(F.col("value").isNull(), F.col("up")).alias("root")).agg(F.bool_or("value").alias("led"), F.min("flip").alias("low"), F.max("flip").alias("high"))
        hangs = F.col("root").isNotNull()
        seen = by_root.groupBy("g", F.col("b").alias("o")).agg(
            F.coalesce(F.bool_or("led"), F.lit(False)).alias("led"), F.bool_or(hangs & (F.col("low") != F.col("high"))).alias("both"), F.count_if(hangs).alias("roots"), F.max("root").alias("root"), F.max(F.when(hangs, F.col("low"))).alias("low")
        )
        asked = waiting.select("g", F.col("b").alias("o"), F.lit(True).alias("asked")).join(seen, ["g", "o"], "left")
        roots = F.coalesce("roots", F.lit(0))
        value = F.when(F.col("led") | F.col("both"), F.lit(False)).when(roots == 0, F.lit(True))
        single = value.isNull() & (roots == 1)
        asked = asked.select("g", "o", value.alias("new"), F.when(single, F.col("root")).alias("new_up"), F.when(single, 1 - F.col("low")).alias("new_flip"))
        after = cut(node.join(asked, ["g", "o"], "left").select("g", "o", F.coalesce("value", "new").alias("value"), F.coalesce("new_up", "up").alias("up"), F.coalesce("new_flip", "flip").alias("flip")))
        drop(node)
        node = _followed(after)
    value_a = node.select("g", F.col("o").alias("a"), "value")
    leaders = links.join(value_a, ["g", "a"], "left").where("leads or value").groupBy("g", F.col("b").alias("o")).agg(F.min("a").alias("first"))
    return opened.join(leaders, ["g", "o"], "left").select("g", "o", F.coalesce("first", "o").alias("decided"))


def _followed(node: DataFrame) -> DataFrame:
    """``node(g, o, value, up, flip)`` with every pointer at its last row, and the values that this gives."""
    held = node
    while True:
        there = node.select("g", F.col("o").alias("up"), F.col("value").alias("value2"), F.col("up").alias("up2"), F.col("flip").alias("flip2"))
        met = node.join(there, ["g", "up"])
        value = F.coalesce("value", F.col("value2") != (F.col("flip") == 1))
        moved = (F.col("up2") != F.col("up")) | (F.col("value").isNull() & F.col("value2").isNotNull())
        after = cut(met.select("g", "o", value.alias("value"), F.col("up2").alias("up"), F.col("flip").bitwiseXOR(F.col("flip2")).alias("flip"), moved.alias("moved")))
        drop(held)
        held, node = after, after.drop("moved")
        if after.where("moved").isEmpty():
            return node


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")

