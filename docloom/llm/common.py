"""Helpers shared by the training-data operators: numbered rows, firsts of classes, batches and shuffle files."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.staging import drop, new_path, shared_dir, stage, temporary

BATCH_BYTES = 4 << 20

__all__ = ["drop", "fields", "first_of_each", "new_path", "numbered", "only_rows", "read", "shared_dir", "shuffle_partitions", "shuffles_removed", "small_batches", "stage", "temporary"]


def numbered(docs: DataFrame) -> DataFrame:
    """(__row, doc) as a staged table: a number for every row, whatever its ``doc_id``, and all its columns, whatever their names."""
    return stage(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct("*").alias("doc")), "numbered", compression="zstd")


def fields(rows: DataFrame) -> DataFrame:
    """(__row, doc_id, text) of ``numbered`` rows; nothing else is read."""
    return rows.select("__row", "doc.doc_id", "doc.text")


def first_of_each(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Of ``numbered`` rows one of each class: the smallest ``doc_id`` (null last), then the smallest ``tie``.

    classes: __row, doc_id, tie, root, one row for each of ``rows``; root is the same within a class only.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "__row")
    return only_rows(rows, stage(classes.groupBy("root").agg(F.min(order).alias("first")).select("first.__row"), "kept-rows"))


def only_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents of ``numbered`` rows whose number ``kept`` has. Never a broadcast: what is kept grows with the table."""
    return rows.join(kept.select("__row").hint("merge"), "__row", "left_semi").select("doc.*")


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in batches of ``BATCH_BYTES`` at most, for this session from now on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, Spark removes a query's shuffle files as soon as the query ends; staged tables don't need them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
