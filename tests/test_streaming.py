"""Stateful operators over several micro-batches, and ordered folds in slices, against plain Python."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import jobs as store_jobs
from docloom.operators import scan
from docloom.staging import new_path
from docloom.streaming import jobs, state

EVENTS = "job_id long, ts timestamp, event_id long, kind string"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def run(spark, batches, schema, operator, name=None):
    """(rows in order of batches, state named ``name``) of a stream that gets each of ``batches`` as a micro-batch of its own."""
    home = new_path(spark, "test-stream")
    out = []
    with jobs._state_store(spark):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
            query = operator(source).writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
            query.foreachBatch(lambda batch, _: out.append([tuple(r) for r in batch.collect()])).start().awaitTermination()
        left = spark.read.format("statestore").option("stateVarName", name).load(f"{home}/checkpoint").count() if name else None
    return [r for rows in out for r in rows], left


CLOSING = (None, datetime.datetime(9999, 1, 1), None, None)


def test_status_over_micro_batches_with_late_rows(spark):
    batches = [
        [(1, at(100), 1, "processing"), (1, at(0), 0, "created"), (2, at(50), 2, "created")],
        [(1, at(30), 3, "viewed"), (3, at(4000), 4, "created")],  # 30 comes before 100, which still waits: not late
        [(1, at(20), 5, "viewed"), (1, at(9000), 6, "completed")],  # 20 is late now: dropped
        [(4, at(9000 + 90000), 7, "created"), (1, at(9100), 8, "failed")],
        [CLOSING],
    ]
    got, left = run(spark, batches, EVENTS, lambda s: state.status_intervals(s, "10 minutes"), "current")
    kept = spark.createDataFrame([r for b in batches[:-1] for r in b if r[2] != 5], EVENTS)
    assert sorted(got) == sorted(tuple(r) for r in jobs.status_intervals(kept).collect())
    assert left == 0


def test_progress_ends_with_the_failure(spark):
    batches = [
        [(1, at(10), 1, "created"), (1, at(5), 0, "created"), (2, at(1), 9, "failed")],
        [(1, at(700), 2, "failed"), (2, at(800), 3, "created")],
        [(1, at(1500), 4, "completed"), (3, at(5000), 5, "created")],
        [CLOSING],
    ]
    got, left = run(spark, batches, EVENTS, state.progress, "waiting")
    rows = [r for b in batches[:-1] for r in b]
    twin = jobs.until_failure(spark.createDataFrame(rows, EVENTS).withColumnRenamed("kind", "event_type")).select("job_id", "event_id", "event_type", "step")
    assert sorted(got) == sorted(tuple(r) for r in twin.collect()) == [(1, 0, "created", 1), (1, 1, "created", 2), (1, 2, "failed", 3), (2, 9, "failed", 1), (3, 5, "created", 1)]
    assert left == 0


def test_lock_is_freed_by_release_and_by_time(spark):
    starts = [(0, "start"), (60, "start"), (100, "release"), (120, "start"), (719, "start"), (721, "start"), (5000, "start")]
    events = [(7, at(s), i, kind) for i, (s, kind) in enumerate(starts)]
    got, left = run(spark, [events[:3][::-1], events[3:], [CLOSING]], EVENTS, state.run_once, "held")
    assert sorted(e for _, e in got) == [0, 3, 5, 6] and left == 0


def test_trends_are_those_of_the_batch_twin(spark):
    rng = random.Random(1)
    samples = [(f"a{i % 3}", at(i * 40 + rng.randint(0, 200)), i, rng.uniform(0, 100), rng.uniform(0, 900)) for i in range(240)]
    schema = "agent string, ts timestamp, event_id long, cpu double, memory double"
    got, ring = run(spark, [samples[:100], samples[100:160], samples[160:], [(None, CLOSING[1], None, None, None)]], schema, state.trends, "ring")
    twin = jobs.trends(spark.createDataFrame(samples, schema).withColumnsRenamed({"cpu": "cpu_percent", "memory": "memory_mb"}))
    names = ["event_id", "agent", "history", "cpu_trend", "mean_cpu", "memory_trend", "mean_memory"]

    def plain(rows):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)

    assert plain(got) == plain(tuple(r[n] for n in names) for r in twin.collect())
    assert max(r[2] for r in got) == 30 and ring == 90
    assert {r[3] for r in got} == {"stable", "increasing", "decreasing"}


def test_hours_are_appended_once_and_dropped_after_a_week(spark):
    home = new_path(spark, "test-hours")
    events = [(i, at(3600 * i), "a", 1.0) for i in range(24 * 9)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    path = f"{home}/table"
    for part in (events[:100], events[100:], [(None, CLOSING[1], None, None)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{home}/in")
        jobs.hourly_sink(jobs.hourly_metrics(spark.readStream.schema(schema).parquet(f"{home}/in"), "value"), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 24 * 7 and rows.agg(F.min("hour"), F.max("hour")).first() == (at(3600 * 24 * 2), at(3600 * (24 * 9 - 1)))
    again = rows.where(f"hour >= timestamp '{at(3600 * 24 * 5)}'").drop("hour_key").collect()
    jobs.write_hours(spark.createDataFrame(again, rows.drop("hour_key").schema), path)  # a batch that comes again
    assert spark.read.parquet(path).count() == 24 * 7


# ordered folds


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(scan, "ROWS_IN_SLICE", 40)


def test_counter_of_one_key_is_the_fold(spark, small_slices):
    rng = random.Random(2)
    deltas = [(None if i == 5 else 1, at(i), i, rng.choice([1, -1, -1, 0])) for i in range(500)] + [(2, at(3), 900, None), (2, at(4), 901, 2)]
    got = {r.event_id: r.active for r in jobs.active_counter(spark.createDataFrame(deltas, "job_id long, ts timestamp, event_id long, delta int"), "job_id", "delta").collect()}
    want, held = {}, {}
    for key, _, event_id, delta in deltas:
        held[key] = max(0, held.get(key, 0) + (delta or 0))
        want[event_id] = held[key]
    assert got == want


def test_no_window_holds_a_key(spark, small_slices):
    rows = spark.createDataFrame([(1, at(i), i, 1) for i in range(200)], "job_id long, ts timestamp, event_id long, delta int")
    cut = scan.sliced(rows, "job_id", ["ts", "event_id"])
    assert cut.groupBy("slice").count().agg(F.max("count")).first()[0] < 120 and cut.select("slice").distinct().count() >= 4
    summed = scan.running_sums(rows, "job_id", ["ts", "event_id"], "delta")
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Window \[", plan)  # those over rows and over slices ended in staged tables
    assert summed.agg(F.max("running")).first()[0] == 200


def test_log_of_one_key_is_in_order(spark, small_slices):
    rows = [(1, at(i // 2), i, f"k{i}") for i in range(300)]
    shuffled = random.Random(3).sample(rows, len(rows))
    got = jobs.accumulated_log(spark.createDataFrame(shuffled, "job_id long, ts timestamp, event_id long, event_type string")).collect()
    assert [tuple(r) for r in got] == [(1, ",".join(r[3] for r in rows))]


def test_lines_of_one_document_are_placed(spark, small_slices):
    lines = [(1, i, "x" * (i % 7) + " " * (i % 3)) for i in range(1, 260)] + [(2, 1, " "), (2, 2, "b")]
    got = {(r.doc_id, r.line_no): (r.line, r.char_start, r.char_end) for r in store_jobs.line_references(spark.createDataFrame(lines, "doc_id long, line_no int, line string")).collect()}
    want, place = {}, {}
    for doc, no, line in lines:
        start = place.get(doc, 0)
        place[doc] = start + len(line) + 1
        if line.strip():
            want[doc, no] = line.strip(" "), start, start + len(line)
    assert got == want


def test_folds_of_no_rows(spark):
    empty = spark.createDataFrame([], "job_id long, ts timestamp, event_id long, delta int, event_type string")
    assert jobs.active_counter(empty, "job_id", "delta").count() == 0 and jobs.accumulated_log(empty).count() == 0
