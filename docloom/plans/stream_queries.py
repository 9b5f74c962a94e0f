"""Queries over job events and metric samples, streams run to their end among them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans.fixtures import duck
from docloom.plans.registration import Registry
from docloom.sources.cache import ChunkCache
from docloom.staging import new_path
from docloom.streaming import jobs as W
from docloom.streaming import state as S

registry = Registry()
query = registry.query


def stream(sql: str | None):
    """Register a function of the event stream."""

    def register(function):
        def run(spark, sf_dir):
            return function(W.event_stream(spark, sf_dir))

        run.__doc__, run.__name__ = function.__doc__, function.__name__
        registry.queries[function.__name__] = run
        if sql:
            registry.sql[function.__name__] = sql
        return function

    return register


@stream("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS most FROM events GROUP BY 1, 2")
def w06_hourly_metrics(events):
    rows = W.finished(W.hourly_metrics(events, "value"), "complete")
    return rows.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"), F.round("most", 4).alias("most"))


@stream("SELECT event_type, CAST(sum(event_id % 5) AS BIGINT) AS counter FROM events GROUP BY 1")
def w13_counter(events):
    return W.finished(W.counters(events, "event_type", F.col("event_id") % 5), "complete")


SAMPLES = "SELECT event_id, 'agent' || CAST(user_id AS VARCHAR) AS agent, ts, value AS cpu_percent, value * 10 AS memory_mb, CAST(user_id % 60 AS INT) AS num_threads FROM events"


def samples(events):
    return events.select("event_id", F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("agent"), "ts", F.col("value").alias("cpu_percent"), (F.col("value") * 10).alias("memory_mb"), (F.col("user_id") % 60).cast("int").alias("num_threads"))


@stream(
    f"""WITH s AS ({SAMPLES}) SELECT event_id, agent, 'high_cpu' AS alert FROM s WHERE cpu_percent > 80 UNION ALL SELECT event_id, agent, CASE WHEN memory_mb > 1000 THEN 'critical_memory' ELSE 'high_memory' END FROM s WHERE memory_mb > 500 UNION ALL SELECT event_id, agent, 'many_threads' FROM s WHERE num_threads > 50"""
)
def w09_metric_alerts(events):
    return W.finished(W.alerts(samples(events)))


@stream(
    """WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t, event_type = 'error' AS release, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('click', 'error')),
    l AS (SELECT job_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS held, FALSE AS taken FROM (SELECT DISTINCT job_id FROM e) j
      UNION ALL SELECT l.job_id, e.i, e.event_id, CASE WHEN e.release THEN NULL WHEN l.held IS NULL OR e.t - l.held >= 600 THEN e.t ELSE l.held END, NOT e.release AND (l.held IS NULL OR e.t - l.held >= 600) FROM l JOIN e ON e.job_id = l.job_id AND e.i = l.i + 1)
    SELECT job_id, event_id FROM l WHERE taken"""
)
def w04_w04b_run_once_lock(events):
    """Starts that the lock lets through, with releases between them."""
    kind = F.when(F.col("event_type") == "error", "release").otherwise("start")
    starts = events.where("event_type in ('click', 'error')").select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind"))
    return W.finished(S.run_once(S.with_closing_row(starts)))


@query("SELECT date_trunc('day', ts) AS start, count(DISTINCT agent) AS agents, round(sum(cpu_percent), 4) AS cpu, round(sum(memory_mb), 4) AS memory FROM {metric_samples} GROUP BY 1", "metric_samples")
def w10_fleet_summary(t):
    return W.fleet_summary(t.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "agents", F.round("cpu", 4).alias("cpu"), F.round("memory", 4).alias("memory"))


def _trend(value: str, slope: int) -> str:
    return f"CASE WHEN n < 5 OR abs(({value} - first_{value}) / n) <= {slope} THEN 'stable' WHEN {value} > first_{value} THEN 'increasing' ELSE 'decreasing' END"


TRENDS = f"""WITH w AS (SELECT event_id, agent, cpu_percent, memory_mb, count(*) OVER h AS history, count(*) OVER l AS n, first_value(cpu_percent) OVER l AS first_cpu_percent, first_value(memory_mb) OVER l AS first_memory_mb, avg(cpu_percent) OVER l AS c, avg(memory_mb) OVER l AS m FROM {{metric_samples}}
    WINDOW h AS (PARTITION BY agent ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), l AS (PARTITION BY agent ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT event_id, agent, history, {_trend("cpu_percent", 2)} AS cpu_trend, round(c, 6) AS mean_cpu, {_trend("memory_mb", 10)} AS memory_trend, round(m, 6) AS mean_memory FROM w"""


@query(TRENDS, "metric_samples")
def w07_w08_metric_trend(t):
    return W.trends(t).withColumns({c: F.round(c, 6) for c in ("mean_cpu", "mean_memory")})


@stream(duck(TRENDS).replace("count(*) OVER h AS history", "CAST(count(*) OVER h AS INT) AS history"))
def w07_w08_metric_trend_stream(events):
    """The same from a ring of samples in state, ordered under the watermark."""
    rows = samples(events).select("agent", "ts", "event_id", F.col("cpu_percent").alias("cpu"), F.col("memory_mb").alias("memory"))
    return W.finished(S.trends(S.with_closing_row(rows))).withColumns({c: F.round(c, 6) for c in ("mean_cpu", "mean_memory")})


def job_events(events):
    """(job_id, ts, event_id, kind), as the fixture ``job_events`` has them."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("viewed")
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind"))


INTERVALS = "SELECT job_id, event_type AS status, epoch_us(ts) AS since_us, least(lead(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, event_id), epoch_us(ts) + CAST(1000000 AS BIGINT) * CASE WHEN event_type IN ('completed', 'failed') THEN 86400 ELSE 3600 END) AS until_us FROM {job_events}"


@stream(duck(INTERVALS))
def w02_status_stream(events):
    """From when until when each status can be read, from state that ends with its time to live."""
    return W.finished(S.status_intervals(S.with_closing_row(job_events(events))))


@stream(duck(INTERVALS + " WHERE event_type = 'completed'"))
def w03_result_stream(events):
    """The same for results: a job's result is kept for a day, or until its next one."""
    return W.finished(S.status_intervals(S.with_closing_row(job_events(events).where("kind = 'completed'"))))


@query(INTERVALS, "job_events")
def w02_status_intervals(t):
    return W.status_intervals(t.withColumnRenamed("event_type", "kind"))


PROGRESS = """SELECT job_id, event_id, event_type, CAST(step AS INT) AS step FROM (SELECT *, row_number() OVER w AS step, coalesce(max(CASE WHEN event_type = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM {job_events} WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) q WHERE before = 0"""


@stream(duck(PROGRESS))
def w01_progress_stream(events):
    """Updates of a job up to its failure, ordered in state under the watermark."""
    return W.finished(S.progress(S.with_closing_row(job_events(events))))


@stream("WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS most FROM events GROUP BY 1, 2) SELECT * FROM h WHERE hour > (SELECT max(hour) FROM h) - INTERVAL 7 DAY")
def w06_hourly_metrics_retained(events):
    """Closed hours, appended to an hourly table that keeps seven days."""
    rows = W.retained_hours(W.hourly_metrics(S.with_closing_row(events), "value"))
    return rows.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"), F.round("most", 4).alias("most"))


@query(
    """WITH RECURSIVE s AS (SELECT job_id, event_id, delta, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM {job_events}),
    r AS (SELECT job_id, event_id, delta, sum(delta) OVER (PARTITION BY job_id ORDER BY i) AS t, i FROM s) SELECT job_id, event_id, CAST(t - least(0, min(t) OVER (PARTITION BY job_id ORDER BY i)) AS BIGINT) AS active FROM r""",
    "job_events",
)
def w05_active_jobs_counter(t):
    return W.active_counter(t, "job_id", "delta").select("job_id", "event_id", "active")


@query(
    """WITH m AS (SELECT max(ts) AS now FROM {job_events}), l AS (SELECT job_id, event_type AS status, ts, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS nth FROM {job_events})
    SELECT job_id, status, ts FROM l CROSS JOIN m WHERE nth = 1 AND floor(epoch(now)) - floor(epoch(ts)) < CASE WHEN status IN ('completed', 'failed') THEN 86400 ELSE 3600 END""",
    "job_events",
)
def w02_w03_status_with_ttl(t):
    return W.live_status(t, t.agg(F.max("ts").cast("timestamp").alias("now")))


@query(PROGRESS, "job_events")
def w01_progress_until_failure(t):
    return W.until_failure(t).select("job_id", "event_id", "event_type", "step")


@query("WITH l AS (SELECT agent, cpu_percent, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, event_id DESC) AS nth FROM {metric_samples}) SELECT count(*) FILTER (WHERE cpu_percent <= 80) AS healthy, count(*) FILTER (WHERE cpu_percent > 80) AS unhealthy, bool_and(cpu_percent <= 80) AS all_healthy FROM l WHERE nth = 1", "metric_samples")
def w14_fleet_health(t):
    return W.fleet_health(t)


@query("SELECT doc_id, page_number FROM {doc_pages} WHERE NOT (doc_id % 3 = 0 AND 48 - doc_id % 48 < CASE WHEN page_number % 2 = 0 THEN 12 ELSE 24 END)", "doc_pages")
def w12_chunk_cache(p):
    """Pages that are in no live entry: a document in three was cached, some hours ago, for a day or half of one."""
    rows = p.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("document_hash"), F.col("page_number").alias("chunk_index"), "doc_id", "page_number")
    written = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 48 * 3600)
    cache = W.cache_entries(rows.where("doc_id % 3 = 0"), written, F.when(F.col("page_number") % 2 == 0, 43200).otherwise(86400))
    return W.uncached(rows, cache, F.timestamp_seconds(F.lit(1_700_000_000 + 48 * 3600))).select("doc_id", "page_number")


@query("SELECT doc_id, page_number, length(text) AS n, (doc_id % 3 = 0 AND page_number % 2 = 0) OR (doc_id % 3 = 1 AND page_number % 2 = 1) AS cached FROM {doc_pages}", "doc_pages")
def w12_cache_runs(p):
    """Two runs wrote to a stored cache, an hour apart, for an hour and a half and for half of one; a third computes what neither has."""
    spark = p.sparkSession
    rows = p.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("document_hash"), F.col("page_number").alias("chunk_index"), "doc_id", "page_number", "text")
    value = T.StructType([T.StructField("n", T.IntegerType())])
    cache = ChunkCache(spark, new_path(spark, "cache") + "/table", value, buckets=16)

    def compute(missing):
        return missing.select("document_hash", "chunk_index", F.length("text").alias("n"))

    hour = 3600
    start, now = 1_700_000_000, F.timestamp_seconds(F.lit(1_700_000_000 + 2 * hour))
    early, late = rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 = 1")
    cache.put(compute(early), F.timestamp_seconds(F.lit(start)), F.when(F.col("chunk_index") % 2 == 0, 3 * hour).otherwise(hour))
    cache.put(compute(late), F.timestamp_seconds(F.lit(start + hour)), F.when(F.col("chunk_index") % 2 == 1, 2 * hour).otherwise(hour // 2))
    known = cache.found(rows, now).select("doc_id", "page_number", "n", F.lit(True).alias("cached"))
    new = cache.missing(rows, now).select("doc_id", "page_number", F.length("text").alias("n"), F.lit(False).alias("cached"))
    return known.union(new)
