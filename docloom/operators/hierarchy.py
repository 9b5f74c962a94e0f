"""Hierarchies of rows with parent keys: depth, context, order of generation, aggregation strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.iterate import depths, root_paths


def relationships(policies: DataFrame) -> DataFrame:
    """(job_id, policy_id, children in order) of every policy that has some."""
    rows = policies.where("parent_id is not null").groupBy("job_id", F.col("parent_id").alias("policy_id"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("policy_id").alias("id")))), lambda c: c["id"]).alias("children"))


def plan(policies: DataFrame) -> DataFrame:
    """Each policy with depth, root, number of children, and whether it is a leaf."""
    sizes = policies.groupBy("job_id", F.col("parent_id").alias("policy_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return (
        policies.join(depths(policies, "job_id", "policy_id", "parent_id"), ["job_id", "policy_id"])
        .join(sizes, ["job_id", "policy_id"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("is_leaf", F.col("n_children") == 0)
    )


def leaves(policies: DataFrame) -> DataFrame:
    """Policies without children."""
    parents = policies.where("parent_id is not null").select("job_id", F.col("parent_id").alias("policy_id")).distinct()
    return policies.join(parents, ["job_id", "policy_id"], "left_anti")


def generation_order(planned: DataFrame) -> DataFrame:
    """Leaves deepest first, then the others deepest first."""
    order = Window.partitionBy("job_id").orderBy(F.desc("is_leaf"), F.desc_nulls_last("depth"), "ord")
    return planned.select("job_id", "policy_id", F.row_number().over(order).alias("nth"))


def context(policies: DataFrame) -> DataFrame:
    """Parent title, siblings before in order, and children with cut descriptions."""
    parents = policies.select("job_id", F.col("policy_id").alias("parent_id"), F.col("title").alias("parent_title"))
    listed = policies.where("parent_id is not null").groupBy("job_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("ord", "policy_id", F.left("description", F.lit(100)).alias("d")))).alias("c"))
    own = listed.select("job_id", F.col("parent_id").alias("policy_id"), F.transform("c", lambda x: F.concat_ws(": ", x["policy_id"], x["d"])).alias("children"))
    siblings = listed.select("job_id", "parent_id", F.transform("c", lambda x: x["policy_id"]).alias("family"))
    none = F.array().cast("array<string>")
    return (
        policies.join(parents, ["job_id", "parent_id"], "left")
        .join(siblings, ["job_id", "parent_id"], "left")
        .join(own, ["job_id", "policy_id"], "left")
        .select("job_id", "policy_id", "parent_title", F.coalesce(F.array_remove("family", F.col("policy_id")), none).alias("siblings"), F.coalesce("children", none).alias("children"))
    )


def aggregation_strategy(policies: DataFrame) -> DataFrame:
    """Of policies with children: sequential where their numeric suffixes run without a gap, routing where all titles differ, else conditional."""
    suffix = F.expr("try_cast(regexp_extract(policy_id, '([0-9]+)$', 1) AS long)")
    kids = policies.where("parent_id is not null").groupBy("job_id", F.col("parent_id").alias("policy_id"))
    seen = kids.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("title").alias("titles"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", suffix.alias("s")))), lambda c: c["s"]).alias("suffixes"),
    )
    runs = F.col("suffixes") == F.sequence(F.array_min("suffixes"), F.array_max("suffixes"))
    return seen.select(
        "job_id",
        "policy_id",
        F.coalesce(runs, F.lit(False)).alias("sequential"),
        F.when((F.col("n") >= 2) & (F.col("titles") == F.col("n")), "scenario_routing").when(runs, "sequential").otherwise("conditional").alias("strategy"),
    )


def overview(planned: DataFrame) -> DataFrame:
    roots = F.count_if(F.col("depth") == 0)
    return planned.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), roots.alias("roots"), F.max("depth").alias("max_depth"), (F.count(F.lit(1)) - roots).alias("sub_policies"), F.count_if("is_leaf").alias("leaves"))


def orphans(policies: DataFrame) -> DataFrame:
    """Policies whose parent is named but absent."""
    ids = policies.select("job_id", F.col("policy_id").alias("parent_id"))
    return policies.where("parent_id is not null").join(ids.hint("merge"), ["job_id", "parent_id"], "left_anti")


def unique_ids(policies: DataFrame) -> DataFrame:
    """The n-th repeat of an id becomes ``id_dup{n}``; if there is exactly one, children of the id move to it."""
    nth = F.row_number().over(Window.partitionBy("job_id", "policy_id").orderBy("ord"))
    numbered = policies.withColumn("nth", nth).withColumn("new_id", F.when(F.col("nth") > 1, F.concat("policy_id", F.lit("_dup"), (F.col("nth") - 1).cast("string"))).otherwise(F.col("policy_id")))
    moved = numbered.groupBy("job_id", F.col("policy_id").alias("parent_id")).agg(F.count(F.lit(1)).alias("n"), F.max_by("new_id", "nth").alias("moved_to")).where("n = 2").drop("n")
    return numbered.join(moved, ["job_id", "parent_id"], "left").select("job_id", "ord", F.col("new_id").alias("policy_id"), F.coalesce("moved_to", "parent_id").alias("parent_id"), "title", "description", "confidence")


def flattened(policies: DataFrame) -> DataFrame:
    """(job_id, root_id, policy_id, nth_of_root, nth): all policies below their roots in pre-order, of each root and of the whole job; children in order."""
    rows = policies.select(F.col("job_id").alias("tree_id"), F.col("policy_id").alias("node_id"), F.col("parent_id").alias("parent_node_id"), F.col("ord").alias("sibling_ord"), F.lit("policy").alias("node_type"))
    tops = policies.select(F.col("job_id").alias("tree_id"), F.col("policy_id").alias("root_id"), F.col("ord").alias("root_ord"))
    paths = root_paths(rows, "false").where(~F.col("cyclic")).withColumn("root_id", F.get("path", 0)).join(tops, ["tree_id", "root_id"])
    of_root = Window.partitionBy("tree_id", "root_id").orderBy("ords")
    of_job = Window.partitionBy("tree_id").orderBy("root_ord", "root_id", "ords")
    return paths.select(F.col("tree_id").alias("job_id"), "root_id", F.col("node_id").alias("policy_id"), F.row_number().over(of_root).alias("nth_of_root"), F.row_number().over(of_job).alias("nth"))
