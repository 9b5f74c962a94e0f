"""Recursion over tables of parents and children: pointer doubling, frontiers and components over staged tables.

Every loop ends at a fixpoint; none has a cap on its rounds. Pointer doubling and components take as many rounds
as the logarithm of the longest chain, a frontier as many as its longest path outside the trees of its start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.staging import drop, stage

MOST_PARTS = 16


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    return stage(df, "round")


def gathered(parts: list[DataFrame], more: DataFrame) -> list[DataFrame]:
    """``parts`` of a loop's rounds and one more; as soon as they are ``MOST_PARTS`` they become one table, so plans don't grow with the rounds."""
    parts = [*parts, more]
    return [cut(reduce(DataFrame.unionByName, parts))] if len(parts) == MOST_PARTS else parts


def depths(nodes: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """(group, node, depth, root) by pointer doubling: as many rounds as the logarithm of the depth.

    A node whose parent is null or absent is a root, of depth 0. Nodes on or below a cycle have a null depth and root.
    Joins are by merge: a table of ids is far larger than its file, by whose size Spark would broadcast it in each round.
    """
    ids = nodes.select(F.col(group).alias("g"), F.col(node).alias("id"), F.col(parent).alias("up"))
    known = ids.select("g", F.col("id").alias("up")).distinct().withColumn("there", F.lit(True))
    state = cut(
        ids.join(known.hint("merge"), ["g", "up"], "left").select(
            "g", "id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).alias("depth"), F.when(F.col("there"), F.col("up")).otherwise(F.col("id")).alias("top")
        )
    )
    # A round that closes nothing leaves only cycles: any deeper chain has nodes that this round reaches the root from.
    before = None
    while (still_open := state.where("up is not null").count()) and still_open != before:
        before = still_open
        above = state.select("g", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("top").alias("top2"))
        after = cut(
            state.join(above.hint("merge"), ["g", "up"], "left").select(
                "g", "id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("top2", "top").alias("top")
            )
        )
        drop(state)
        state = after
    looped = F.col("up").isNotNull()
    return state.select(F.col("g").alias(group), F.col("id").alias(node), F.when(~looped, F.col("depth")).alias("depth"), F.when(~looped, F.col("top")).alias("root"))


def closure(start: DataFrame, edges: DataFrame, group: str, node: str) -> DataFrame:
    """(group, node) reachable from ``start`` over ``edges(group, node, next)``: one join per round over all groups at once."""
    edges = cut(edges.select(group, node, "next").distinct())
    seen = cut(start.select(group, node).distinct())
    frontier = seen
    while True:
        reached = frontier.join(edges, [group, node]).select(group, F.col("next").alias(node)).distinct()
        frontier = cut(reached.join(seen, [group, node], "left_anti"))
        if frontier.isEmpty():
            drop(edges, frontier)
            return seen
        after = cut(seen.union(frontier))
        drop(seen)
        seen = after


def root_paths(nodes: DataFrame, stops: str) -> DataFrame:
    """Every node with its path from the root: ``nodes(tree_id, node_id, parent_node_id, sibling_ord, node_type)``.

    No path goes on below a node for which ``stops`` holds, nor to a node that it already has (``cyclic`` marks those).
    Paths grow by pointer doubling: a round puts the path that ends at a path's first node before it.
    """
    rows = nodes.select("tree_id", "node_id", "node_type", F.col("parent_node_id").alias("up"), F.coalesce(F.col("sibling_ord").cast("long"), F.lit(0)).alias("o"), F.expr(stops).alias("stop"))
    onward = rows.where(~F.coalesce("stop", F.lit(False))).select("tree_id", F.col("node_id").alias("up")).distinct()
    below = rows.where("up is not null").join(onward, ["tree_id", "up"], "left_semi").select("tree_id", "node_id", "node_type", "up", "o")
    tops = rows.where("up is null").select("tree_id", "node_id", "node_type", "up", F.lit(0).cast("long").alias("o"))
    state = cut(tops.unionByName(below).select("tree_id", "node_id", "node_type", "up", F.array("node_id").alias("path"), F.array("o").alias("ords")))
    while not state.where("up is not null").isEmpty():
        simple = F.size(F.array_distinct("path")) == F.size("path")
        above = state.where(simple).select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("ords").alias("ords2"))
        longer = state.where("up is not null").join(above, ["tree_id", "up"]).select(
            "tree_id", "node_id", "node_type", F.col("up2").alias("up"), F.concat("path2", "path").alias("path"), F.concat("ords2", "ords").alias("ords")
        )
        before_end = F.slice("path", F.lit(1), F.size("path") - 1)
        after = cut(state.where("up is null").unionByName(longer.where(F.size(F.array_distinct(before_end)) == F.size(before_end))))
        drop(state)
        state = after
    return state.select("tree_id", "node_id", "node_type", "path", "ords", F.array_contains(F.slice("path", F.lit(1), F.size("path") - 1), F.element_at("path", -1)).alias("cyclic"))


def path_ways(nodes: DataFrame, stops: str) -> DataFrame:
    """(tree_id, node_id, ways, edges): how many paths lead from a root to a node, and the longest one's edges; no path is listed.

    ``nodes`` as for ``root_paths``; a node with several parents has several rows, and no path goes on below a node for
    which ``stops`` holds. By doubling: a round has, per node, the number of paths of exactly 2 ** k edges from each node above
    it, and of all shorter ones from a root; both are sums, so stacked diamonds stay as few rows as they have nodes. ways is a whole
    decimal, null where it has more than 38 digits and below a cycle, where it has no end.
    """
    rows = nodes.select("tree_id", "node_id", F.col("parent_node_id").alias("up"), F.expr(stops).alias("stop"))
    onward = rows.where(~F.coalesce("stop", F.lit(False))).select("tree_id", F.col("node_id").alias("up")).distinct()
    below = rows.where("up is not null").join(onward, ["tree_id", "up"], "left_semi").select("tree_id", "node_id", "up", F.lit(1).alias("edges"))
    tops = rows.where("up is null").select("tree_id", "node_id", "up", F.lit(0).alias("edges")).distinct()
    kind = "decimal(38,0)"

    def added(found: DataFrame) -> DataFrame:
        return cut(found.groupBy("tree_id", "node_id", "up").agg(F.try_sum("ways").alias("ways"), F.max("edges").alias("edges")))

    state = added(tops.unionByName(below).withColumn("ways", F.lit(1).cast(kind)))
    most = nodes.groupBy("tree_id").agg(F.count_distinct("node_id").alias("n")).agg(F.max("n")).first()[0] or 0
    length = 1
    while length < most and not state.where("up is not null").isEmpty():
        above = state.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("ways").alias("ways2"), F.col("edges").alias("edges2"))
        longer = state.where("up is not null").join(above, ["tree_id", "up"]).select(
            "tree_id", "node_id", F.col("up2").alias("up"), F.try_multiply("ways", "ways2").cast(kind).alias("ways"), (F.col("edges") + F.col("edges2")).alias("edges")
        )
        after = added(state.where("up is null").unionByName(longer))
        drop(state)
        state, length = after, 2 * length
    endless = state.where("up is not null").select("tree_id", "node_id").distinct().withColumn("endless", F.lit(True))
    found = state.where("up is null").drop("up").join(endless, ["tree_id", "node_id"], "left")
    return found.select("tree_id", "node_id", F.when(F.col("endless").isNull(), F.col("ways")).alias("ways"), "edges")


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Link neighbours of each node to the smallest node among them and itself.

    large star: neighbours above the node; small star: the node and those below. Both sides of the join come
    straight from tables, so that Spark can split the centre of a giant class.
    """
    if small:
        ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    lowest = stage(ends.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "lowest")
    met = ends.join(lowest, "u")
    if small:
        moved = met.select(F.col("v").alias("a"), F.col("low").alias("b")).union(lowest.select(F.col("u").alias("a"), F.col("low").alias("b")))
    else:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    out = stage(moved.where("a <> b").distinct(), "links")
    drop(lowest)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: root is its component's smallest node.

    Alternating large-star and small-star rounds, as many as the logarithm of the longest chain; two numbers a round
    reach the driver. Self links and repeated links are harmless; null ends are dropped; an empty table gives an
    empty result.
    """

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = stage(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    before, now = None, state(current)
    while now[0] and now != before:
        large = _star(current, small=False)
        after = _star(large, small=True)
        drop(current, large)
        current, before, now = after, now, state(after)
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
