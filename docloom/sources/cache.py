"""A cache of computed chunks that lasts from run to run: a bucketed table that is never shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "cache_key"


def cache_key() -> Column:
    """The key of ``(document_hash, chunk_index)``."""
    return F.concat_ws(":", F.lit("chunk"), "document_hash", F.col("chunk_index").cast("string"))


@dataclass
class ChunkCache:
    """Entries ``(cache_key, value columns, expires_at)`` at ``path``, in ``buckets`` of their key, each file sorted by it.

    Another session that names the same path, columns and buckets finds the same entries. A lookup is a merge join: the rows
    that ask are shuffled to the buckets, the cache is read where it lies. An entry ends at the time it got when it was
    written; of several entries of a key the last to end counts. ``sweep`` rewrites what still lives.
    """

    spark: SparkSession
    path: str
    value: T.StructType
    buckets: int = 64

    @property
    def name(self) -> str:
        return f"docloom_cache_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"

    def _table(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.value.fields)
            self.spark.sql(f"CREATE TABLE {self.name} ({KEY} STRING, {fields}, expires_at TIMESTAMP) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self.spark.table(self.name)

    def put(self, rows: DataFrame, at: Column, ttl_s: Column) -> None:
        """Write ``rows(document_hash, chunk_index, value columns)`` that end ``ttl_s`` seconds after ``at``."""
        self._table()
        ends = F.timestamp_seconds(F.unix_timestamp(at) + ttl_s).alias("expires_at")
        entries = rows.select(cache_key().alias(KEY), *self.value.fieldNames(), ends).repartition(self.buckets, KEY)
        entries.write.bucketBy(self.buckets, KEY).sortBy(KEY).mode("append").option("path", self.path).saveAsTable(self.name)

    def live(self, now: Column) -> DataFrame:
        return self._table().where(F.col("expires_at") > now)

    def missing(self, rows: DataFrame, now: Column) -> DataFrame:
        """``rows(document_hash, chunk_index, ...)`` without a live entry."""
        return rows.withColumn(KEY, cache_key()).join(self.live(now).select(KEY).hint("merge"), KEY, "left_anti").drop(KEY)

    def found(self, rows: DataFrame, now: Column) -> DataFrame:
        """``rows`` with a live entry, with its value."""
        best = self.live(now).groupBy(KEY).agg(F.max_by(F.struct(*self.value.fieldNames()), "expires_at").alias("v"))
        return rows.withColumn(KEY, cache_key()).join(best.hint("merge"), KEY).select(*rows.columns, "v.*")

    def through(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column, ttl_s: Column) -> DataFrame:
        """``rows`` with their values: those that live in the cache from there, the others by ``compute``, which puts them into it first."""
        self.put(compute(self.missing(rows, now)), now, ttl_s)
        return self.found(rows, now)

    def sweep(self, now: Column) -> None:
        """Drop what has ended: the entries that live are written anew."""
        from docloom.staging import drop, stage

        kept = stage(self.live(now), "live-entries")
        kept.repartition(self.buckets, KEY).write.bucketBy(self.buckets, KEY).sortBy(KEY).mode("overwrite").option("path", self.path).saveAsTable(self.name)
        drop(kept)
