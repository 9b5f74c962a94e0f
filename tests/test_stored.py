"""Tables that edits reach, and the cache between runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.sources.cache import ChunkCache
from docloom.sources.keyed import BUCKET, KeyedTable
from docloom.staging import new_path

SCHEMA = "job_id long, status string, note string"


@pytest.fixture
def table(spark):
    rows = spark.createDataFrame([(i, "new", None if i % 3 else "n") for i in range(100)], SCHEMA)
    stored = KeyedTable(spark, new_path(spark, "test-table") + "/t", "job_id", rows.schema, buckets=8)
    stored.create(rows)
    return stored


def files(table):
    return {tuple(r) for r in table._stored().select(BUCKET, F.input_file_name()).distinct().collect()}


def test_edits_rewrite_touched_buckets_only(spark, table):
    before = files(table)
    assert len({b for b, _ in before}) == 8
    changes = spark.createDataFrame([(5, "done", None), (7, None, "seen"), (1000, "absent", None)], SCHEMA)
    touched = set(table._touched(changes))
    table.update(changes)
    after = files(table)
    assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched} and len(touched) < 4
    assert not {f for f in before if f[0] in touched} & after
    table.update(spark.createDataFrame([(5, None, "twice")], SCHEMA))
    got = {r.job_id: (r.status, r.note) for r in table.read().collect()}
    want = {i: ("new", None if i % 3 else "n") for i in range(100)} | {5: ("done", "twice"), 7: ("new", "seen")}
    assert got == want


def test_put_delete_append_and_get(spark, table):
    table.put(spark.createDataFrame([(3, "put", "p"), (200, "put", "q")], SCHEMA))
    table.append(spark.createDataFrame([(None, "null", None), (201, "appended", None)], SCHEMA))
    keys = spark.createDataFrame([(3,), (201,), (999,)], "job_id long")
    assert {(r.job_id, r.status) for r in table.get(keys).collect()} == {(3, "put"), (201, "appended")}
    whole = spark.createDataFrame([(i,) for i in [*range(100), 200, 201]], "job_id long")
    table.delete(whole.where(table.bucket() == 0))  # a bucket that becomes empty goes
    assert table.read().where(table.bucket() == 0).where("job_id is not null").count() == 0
    assert table.read().where(table.bucket() != 0).where("job_id is not null").count() == whole.where(table.bucket() != 0).count()
    table.delete(whole.limit(0))
    assert table.read().where("job_id is null").count() == 1


def test_a_bucket_is_read_alone(spark, table):
    plan = table.get(spark.createDataFrame([(3,)], "job_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and BUCKET in plan.split("PartitionFilters", 1)[1].split("]")[0]


NOW = datetime.datetime(2024, 1, 1)


def test_the_second_run_computes_nothing(spark):
    rows = spark.createDataFrame([(f"h{i % 10}", i // 10, f"text {i}") for i in range(50)], "document_hash string, chunk_index int, text string")
    value = spark.createDataFrame([], "n int").schema
    path = new_path(spark, "test-cache") + "/c"
    computed = []

    def compute(missing):
        computed.append(missing.count())
        return missing.withColumn("n", F.length("text"))

    def run(at, part):
        cache = ChunkCache(spark, path, value, buckets=4)
        return {(r.document_hash, r.chunk_index): r.n for r in cache.through(part, compute, F.lit(at), F.lit(3600)).collect()}

    want = {(r.document_hash, r.chunk_index): len(r.text) for r in rows.collect()}
    assert run(NOW, rows.where("chunk_index < 3")) == {k: v for k, v in want.items() if k[1] < 3}
    spark.sql(f"DROP TABLE {ChunkCache(spark, path, value).name}")  # another session has the files only
    assert run(NOW, rows) == want and run(NOW, rows) == want
    assert computed == [30, 20, 0]
    assert run(NOW + datetime.timedelta(hours=2), rows) == want and computed[-1] == 50
    cache = ChunkCache(spark, path, value, buckets=4)
    assert cache._table().count() == 100
    cache.sweep(F.lit(NOW + datetime.timedelta(hours=2)))
    assert cache._table().count() == 50 and run(NOW + datetime.timedelta(hours=2), rows) == want and computed[-1] == 0


def test_the_cache_is_not_shuffled(spark):
    value = spark.createDataFrame([], "n int").schema
    cache = ChunkCache(spark, new_path(spark, "test-cache") + "/c", value, buckets=16)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("document_hash"), F.lit(1).alias("chunk_index"), F.lit(2).alias("n"))
    cache.put(rows, F.lit(NOW), F.lit(60))
    missing = cache.missing(rows, F.lit(NOW))
    assert missing.count() == 0
    plan = missing._jdf.queryExecution().sparkPlan().toString() + missing._jdf.queryExecution().executedPlan().toString()
    right = plan.rsplit("SortMergeJoin", 1)[1].split("+- ", 1)[1]
    cache_side = [part for part in missing._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in part]
    assert len(cache_side) == 1 and "Bucketed: true" in right
