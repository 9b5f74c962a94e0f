"""Refinement of a policy table after verification: merge duplicates, regroup roots, find the trees that this touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import entities as E
from docloom.operators import quality as Q
from docloom.staging import stage

REGROUPED_FOR = ("too_many_roots", "insufficient_depth")


def merge_duplicates(policies: DataFrame, conditions: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Policies without the duplicates ``pairs(a_id, b_id)``, the conditions that they leave, and (policy_id, survivor).

    Children of a merged policy go to its survivor, and so do its conditions, behind the survivor's own; of those that are alike the first stays.
    """
    taken = stage(Q.survivors(pairs), "survivors")
    up = taken.select(F.col("policy_id").alias("parent_id"), F.col("survivor").alias("new_parent"))
    kept = policies.join(taken, "policy_id", "left_anti").join(up, "parent_id", "left").withColumn("parent_id", F.coalesce("new_parent", "parent_id")).drop("new_parent")
    moved = conditions.join(taken, "policy_id", "left").withColumn("owner", F.coalesce("survivor", "policy_id"))
    # Only owners that took something over can have new doubles; an order that puts their own conditions first.
    numbered = moved.withColumn("place", F.struct(F.col("survivor").isNotNull().alias("taken"), "policy_id", "ord"))
    order = Window.partitionBy("owner").orderBy("place")
    rows = stage(numbered.withColumn("ord", F.row_number().over(order)).select(F.col("owner").alias("policy_id"), "ord", "condition_id", "description"), "owned")
    owners = taken.select(F.col("survivor").alias("policy_id")).distinct()
    doubled = stage(rows.join(owners, "policy_id", "left_semi"), "doubled")
    unique = doubled.join(Q.dedup_conditions(doubled), ["policy_id", "ord", "condition_id"], "left_semi")
    return kept.select(*policies.columns), rows.join(owners, "policy_id", "left_anti").unionByName(unique), taken


def regroup(policies: DataFrame, conditions: DataFrame, metrics: DataFrame, page: Column) -> DataFrame:
    """``policies`` with ``moved``: in jobs with too many roots or too little depth, roots that are no umbrellas go under their best one.

    The level of what moves is its umbrella's plus one.
    """
    jobs = metrics.where(F.col("issue").isin(*REGROUPED_FOR)).select("job_id").distinct()
    asked = policies.join(jobs, "job_id", "left_semi")
    best = stage(E.refined_parents(asked, conditions, page).select("job_id", "policy_id", F.col("parent_id").alias("new_parent")), "new-parents")
    above = policies.select("job_id", F.col("policy_id").alias("new_parent"), (F.col("level") + 1).alias("new_level"))
    return policies.join(best.join(above, ["job_id", "new_parent"]), ["job_id", "policy_id"], "left").select(
        *[F.coalesce("new_parent", "parent_id").alias("parent_id") if c == "parent_id" else F.coalesce("new_level", "level").alias("level") if c == "level" else F.col(c) for c in policies.columns], F.col("new_parent").isNotNull().alias("moved")
    )


def affected_trees(policies: DataFrame, taken: DataFrame) -> DataFrame:
    """(job_id, policy_id) whose trees are made anew: survivors of merges, and all leaves of jobs where something ``moved``."""
    merged = policies.join(taken.select(F.col("survivor").alias("policy_id")).distinct(), "policy_id", "left_semi").select("job_id", "policy_id")
    jobs = policies.where("moved").select("job_id").distinct()
    parents = policies.where("parent_id is not null").select("job_id", F.col("parent_id").alias("policy_id")).distinct()
    leaves = policies.join(jobs, "job_id", "left_semi").join(parents, ["job_id", "policy_id"], "left_anti").select("job_id", "policy_id")
    return merged.union(leaves).distinct()


def refine(policies: DataFrame, conditions: DataFrame, trees: DataFrame, pairs: DataFrame, metrics: DataFrame, page: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merge, regroup, and what follows for ``trees(policy_id)``: (policies with ``moved``, conditions, trees to make anew, summary).

    summary: one row per job with counts before and after.
    """
    kept, held, taken = merge_duplicates(policies, conditions, pairs)
    kept = stage(kept, "kept")
    after = stage(regroup(kept, held, metrics, page), "regrouped")
    anew = stage(affected_trees(after, taken), "anew")
    n = F.count(F.lit(1))
    ids = policies.select("job_id", "policy_id")
    owned = trees.join(ids, "policy_id")
    parts = [
        after.groupBy("job_id").agg(n.alias("policies_after"), F.count_if("moved").alias("policies_reparented")),
        taken.join(ids, "policy_id").groupBy("job_id").agg(n.alias("policies_merged")),
        owned.groupBy("job_id").agg(n.alias("trees_before")),
        owned.join(taken, "policy_id", "left_anti").groupBy("job_id").agg(n.alias("trees_after")),
        anew.groupBy("job_id").agg(n.alias("trees_regenerated")),
    ]
    summary = policies.groupBy("job_id").agg(n.alias("policies_before"))
    for part in parts:
        summary = summary.join(part, "job_id", "left")
    return after, held, anew, summary.na.fill(0)
