"""Event-time operators over job events and metric samples.

Functions of a DataFrame work on a stream and on a batch alike unless they say otherwise; ``finished`` runs a
stream over all that is there and gives its result as a table.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.scan import joined_in_order, running_sums
from docloom.staging import new_path

# Thresholds of alerts and trends, seconds of locks and of status retention.
CPU, MEMORY_HIGH, MEMORY_CRITICAL, THREADS = 80, 500, 1000, 50
LOCK_S, RUNNING_TTL_S, FINISHED_TTL_S = 600, 3600, 86400
HISTORY, TREND, TREND_LEAST = 30, 10, 5
SLOPES = {"cpu": 2, "memory": 10}
RETENTION_DAYS = 7


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A driver table, a file or a folder of files, as a stream of files; its event time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # As a pattern: a stream takes no path of a single file, but files and folders that a pattern finds.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB, on disk and with the checkpoint, as stateful processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run ``stream`` over what is available into Parquet, recovering from its checkpoint; in complete mode each batch replaces the table of the one before."""
    with _state_store(stream.sparkSession):
        return _finished(stream, mode)


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    home = new_path(spark, "stream")
    out = f"{home}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def hourly_metrics(events: DataFrame, value: str, late: str = "2 hours") -> DataFrame:
    hour = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return hour.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("window.start").alias("hour"), "event_type", "n", "total", "most")


def counters(events: DataFrame, key: str, amount: Column) -> DataFrame:
    return events.groupBy(key).agg(F.sum(amount).alias("counter"))


def alerts(samples: DataFrame) -> DataFrame:
    """A row per threshold that a sample passes."""
    found = F.array_compact(
        F.array(
            F.when(F.col("cpu_percent") > CPU, F.lit("high_cpu")),
            F.when(F.col("memory_mb") > MEMORY_CRITICAL, F.lit("critical_memory")).when(F.col("memory_mb") > MEMORY_HIGH, F.lit("high_memory")),
            F.when(F.col("num_threads") > THREADS, F.lit("many_threads")),
        )
    )
    return samples.select("event_id", "agent", F.explode(found).alias("alert"))


def fleet_summary(samples: DataFrame, every: str = "1 day") -> DataFrame:
    return samples.groupBy(F.window("ts", every)).agg(F.count_distinct("agent").alias("agents"), F.sum("cpu_percent").alias("cpu"), F.sum("memory_mb").alias("memory")).select(F.col("window.start").alias("start"), "agents", "cpu", "memory")


def trend(name: str, first: float, last: float, n: int) -> str:
    """Of ``n`` values of a series, cpu or memory: where they go, by the change per value."""
    slope = (last - first) / n
    return "stable" if n < TREND_LEAST or abs(slope) <= SLOPES[name] else "increasing" if slope > 0 else "decreasing"


def trends(samples: DataFrame) -> DataFrame:
    """Batch: of each sample the size of its agent's history, and directions and means of the last ten samples."""
    order = Window.partitionBy("agent").orderBy("ts", "event_id")
    last = order.rowsBetween(1 - TREND, 0)
    n = F.count(F.lit(1)).over(last)

    def direction(name: str, value: str) -> Column:
        slope = (F.col(value) - F.first(value).over(last)) / n
        return F.when((n < TREND_LEAST) | (F.abs(slope) <= SLOPES[name]), "stable").when(slope > 0, "increasing").otherwise("decreasing").alias(f"{name}_trend")

    series = {"cpu": "cpu_percent", "memory": "memory_mb"}
    of_series = [c for name, value in series.items() for c in (direction(name, value), F.avg(value).over(last).alias(f"mean_{name}"))]
    return samples.select("event_id", "agent", F.count(F.lit(1)).over(order.rowsBetween(1 - HISTORY, 0)).alias("history"), *of_series)


def active_counter(events: DataFrame, key: str, delta: str) -> DataFrame:
    """Batch: a running counter that never falls below zero: the running sum, less its lowest point so far where that is negative. No task holds a key."""
    return running_sums(events, key, ["ts", "event_id"], delta).withColumn("active", F.col("running") - F.least(F.lit(0), "lowest")).drop("running", "lowest")


def accumulated_log(events: DataFrame) -> DataFrame:
    """Batch: the kinds of a job's events in order, in one line."""
    return joined_in_order(events, "job_id", ["ts", "event_id"], "event_type", ",").withColumnRenamed("joined", "log")


def ttl_seconds(kind: str) -> int:
    return FINISHED_TTL_S if kind in ("completed", "failed") else RUNNING_TTL_S


def status_intervals(events: DataFrame) -> DataFrame:
    """Batch twin of ``state.status_intervals``: (job_id, status, since_us, until_us) of ``events(job_id, ts, event_id, kind)``."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    following = F.lead(at).over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    ttl = F.when(F.col("kind").isin("completed", "failed"), FINISHED_TTL_S).otherwise(RUNNING_TTL_S)
    return events.select("job_id", F.col("kind").alias("status"), at.alias("since_us"), F.least(following, at + ttl * F.lit(1_000_000).cast("long")).alias("until_us"))


def live_status(events: DataFrame, now: DataFrame) -> DataFrame:
    """Batch: each job's last status, unless it has expired at ``now``, a table of one row with one column of that name."""
    latest = events.groupBy("job_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))
    ttl = F.when(F.col("status").isin("completed", "failed"), FINISHED_TTL_S).otherwise(RUNNING_TTL_S)
    return latest.join(F.broadcast(now)).where(F.unix_timestamp("now") - F.unix_timestamp(F.col("ts").cast("timestamp")) < ttl).select("job_id", "status", "ts")


def until_failure(events: DataFrame) -> DataFrame:
    """Batch twin of the progress stream: events of a job up to and with its first failure, numbered."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    failed_before = F.coalesce(F.max((F.col("event_type") == "failed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumns({"failed_before": failed_before, "step": F.row_number().over(order)}).where("failed_before = 0").drop("failed_before")


def hourly_sink(stream: DataFrame, path: str, days: int = RETENTION_DAYS) -> None:
    """Run ``hourly_metrics`` in append mode into a table at ``path``, one partition an hour, of which those older than ``days`` before the newest go.

    An hour is written when the watermark has passed it, all its rows in one micro-batch; a batch that comes again
    overwrites the partitions that it wrote, so it adds nothing. State ends with the hour, files with the retention.
    """
    query = stream.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).outputMode("append").foreachBatch(lambda batch, _: write_hours(batch, path, days)).start()
    query.awaitTermination()


def write_hours(batch: DataFrame, path: str, days: int = RETENTION_DAYS) -> None:
    spark = batch.sparkSession
    key = F.date_format(F.to_utc_timestamp("hour", F.current_timezone()), "yyyyMMddHH")
    batch.withColumn("hour_key", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour_key").parquet(path)
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    hours = {str(f.getPath().getName()).removeprefix("hour_key="): f.getPath() for f in files.listStatus(home) if str(f.getPath().getName()).startswith("hour_key=")}
    if hours:
        oldest = (datetime.strptime(max(hours), "%Y%m%d%H") - timedelta(days=days)).strftime("%Y%m%d%H")
        for hour, folder in hours.items():
            if hour <= oldest:
                files.delete(folder, True)


def retained_hours(stream: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """The table that ``hourly_sink`` leaves when the stream has ended."""
    path = new_path(stream.sparkSession, "hours") + "/table"
    hourly_sink(stream, path, days)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def cache_entries(rows: DataFrame, at: Column, ttl_s: Column) -> DataFrame:
    """Cache entries of ``rows(document_hash, chunk_index, ...)`` written at a time, with the time at which they end."""
    return rows.withColumn("expires_at", F.timestamp_seconds(F.unix_timestamp(at) + ttl_s))


def uncached(rows: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Rows whose (document_hash, chunk_index) has no entry in the cache that lives at ``now``."""
    live = cache.where(F.col("expires_at") > now).select("document_hash", "chunk_index").distinct()
    return rows.join(live, ["document_hash", "chunk_index"], "left_anti")


def fleet_health(samples: DataFrame) -> DataFrame:
    """Batch: healthy and unhealthy agents by their latest sample."""
    latest = samples.groupBy("agent").agg(F.max_by("cpu_percent", F.struct("ts", "event_id")).alias("cpu"))
    healthy = F.col("cpu") <= CPU
    return latest.agg(F.count_if(healthy).alias("healthy"), F.count_if(~healthy).alias("unhealthy"), F.bool_and(healthy).alias("all_healthy"))
