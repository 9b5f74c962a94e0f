"""Ordered folds of keys of any size: a key is cut into slices of its order, slices are summed up, and the few sums are scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.staging import stage

ROWS_IN_SLICE = 1 << 18


def sliced(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slice``, ascending with ``order`` within a key, as a staged table; about ``ROWS_IN_SLICE`` rows each, whatever a key has.

    Rows that agree in key and order stay in one slice, so ``order`` should tell the rows of a key apart.
    """
    held = stage(rows, "to-slice")
    n = -(-held.count() // ROWS_IN_SLICE)
    return stage(held.repartitionByRange(max(n, 1), key, *order).withColumn("slice", F.spark_partition_id()), "slices")


def running_sums(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``running``, the sum of ``value`` up to and with the row in its key, and ``lowest``, the least of these sums so far.

    Windows hold a slice of a key, or one row for each of its slices; never a key. A null ``value`` counts as zero; null
    keys are one key; an empty table gives an empty result.
    """
    cut = sliced(rows.withColumn("__v", F.coalesce(value, F.lit(0))), key, order)
    inside = Window.partitionBy("slice", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = stage(cut.withColumn("__s", F.sum("__v").over(inside)).withColumn("__low", F.min("__s").over(inside)), "slice-sums")
    slices = summed.groupBy(F.col(key).alias("__k"), F.col("slice").alias("__slice")).agg(F.sum("__v").alias("__sum"), F.min("__s").alias("__least"))
    earlier = Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    placed = stage(placed.withColumn("__floor", F.min(F.col("__before") + F.col("__least")).over(earlier)).drop("__sum", "__least"), "slice-starts")
    met = summed.join(placed, F.col(key).eqNullSafe(F.col("__k")) & (F.col("slice") == F.col("__slice")))
    lowest = F.least(F.col("__floor"), F.col("__before") + F.col("__low"))
    return met.withColumns({"running": F.col("__before") + F.col("__s"), "lowest": lowest}).drop("__v", "__s", "__low", "__k", "__slice", "__before", "__floor", "slice")


def joined_in_order(rows: DataFrame, key: str, order: list[str], text: str, separator: str) -> DataFrame:
    """(key, joined): the texts of a key in order; a slice is joined in one task, then the slices' texts are."""
    cut = sliced(rows.select(key, *order, text), key, order)
    parts = cut.groupBy(key, "slice").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text")))).alias("l"))
    texts = parts.select(key, "slice", F.array_join(F.transform("l", lambda x: x["__text"]), separator).alias("t"))
    whole = texts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slice", "t"))).alias("l"))
    return whole.select(key, F.array_join(F.transform("l", lambda x: x["t"]), separator).alias("joined"))
