"""Bounded samples of labelled rows, for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stage

ERROR, MARGIN = 0.02, 1.2
TRAIN_BYTES = 192 << 20


def fold(doc_id: str, folds: int):
    """crc32 of the id's text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` different rows of ``labelled(doc_id, label)``, those with the smallest hashed ids: as good as random, always the same.

    A sketch of the number of different rows, a fixed size in every task, tells how far the hashes may go, so that the
    tasks send little more than ``rows`` rows on to be ordered, however many tasks and repeats there are.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    different = labelled.agg(F.approx_count_distinct(F.xxhash64("doc_id", "label"), ERROR)).first()[0]
    if MARGIN * rows < different:
        labelled = labelled.where(h <= int(MARGIN * rows / different * (2**63 - 1)))
    return labelled.select("doc_id", "label").distinct().orderBy(h, "doc_id", "label").limit(rows)


def within_bytes(sample: DataFrame, size: Column, order: list[str], most: int = TRAIN_BYTES) -> DataFrame:
    """The rows of a bounded sample, in hashed order, as long as their sizes add up to ``most`` at most; so long texts make the sample fewer rows, not more bytes.

    The sample's rows are staged; only their sizes, a number a row, meet in one task.
    """
    rows = stage(sample.withColumn("__size", size.cast("long")).withColumn("__row", F.monotonically_increasing_id()), "sample")
    before = Window.orderBy(F.xxhash64(*order), "__row").rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.select("__row", "__size", *order).withColumn("__sum", F.sum("__size").over(before)).where(F.col("__sum") <= most).select("__row")
    return rows.join(F.broadcast(fits), "__row", "left_semi").drop("__row", "__size")
