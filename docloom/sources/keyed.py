"""A stored table that edits reach: rows lie in buckets of their key, and an edit rewrites the buckets of its keys only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.jobs import latest_wins, merged, without_keys
from docloom.staging import drop, stage

BUCKET = "__bucket"


@dataclass
class KeyedTable:
    """A Parquet table at ``path`` with one partition per bucket of ``key``; it has as many buckets as it was created with.

    One writer at a time. An edit first stages the new rows of the buckets that it touches and then swaps them in by
    dynamic partition overwrite, so a lost executor or a failed edit leaves the table as it was. Which buckets are touched is at most ``buckets``
    numbers for the driver. Reads of keys look into their buckets only. Rows with a null key are one bucket's.
    """

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = 64

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        dealt = rows.select(*fields, self.bucket().alias(BUCKET)).repartition(BUCKET)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows, "errorifexists")

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``: their buckets are read, and nothing else."""
        asked = keys.select(self.key).distinct()
        return self._stored().where(F.col(BUCKET).isin(self._touched(asked))).drop(BUCKET).join(asked, self.key, "left_semi")

    def edit(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the buckets of ``keys`` by what ``change`` makes of their rows; keys stay what they are."""
        touched = self._touched(keys)
        if not touched:
            return
        new = stage(change(self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET)).select(*self.schema.fieldNames()), "edited")
        filled = self._touched(new)
        self._write(new, "overwrite")
        home = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for gone in set(touched) - set(filled):
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(home, f"{BUCKET}={gone}"), True)
        drop(new)

    def update(self, changes: DataFrame) -> None:
        """Non-null columns of ``changes``, one row a key, overwrite those of the same key."""
        self.edit(changes, lambda old: merged(old, changes, self.key))

    def put(self, rows: DataFrame) -> None:
        """Rows of the keys of ``rows`` are replaced by these, others stay."""
        self.edit(rows, lambda old: latest_wins(old, rows.select(*self.schema.fieldNames()), self.key))

    def delete(self, keys: DataFrame) -> None:
        self.edit(keys, lambda old: without_keys(old, keys, self.key))
