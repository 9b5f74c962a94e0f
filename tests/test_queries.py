"""Every query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from docloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else f"{float(value) + 0.0:.5f}"
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.SQL:
        return
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES


LARGE_JOBS = "h01b_h01c_flatten_policies h08_generation_order h05_t23_policy_context e06_e07_merge_similar e10_best_parent r06_best_parent_refined r06a_r06d_parent_signals e11_reparent r03_r04_regroup q01_duplicate_policies r08_r09_refine".split()


@pytest.mark.parametrize("name", LARGE_JOBS)
def test_jobs_grow_with_the_table(duck, name):
    """These queries work on twenty jobs, whatever the number of policies."""
    fixture = registry.SQL[name].split("f_large_jobs AS (", 1)[1].split("{part}")[0]
    assert "p_partkey%20 AS job_id" in fixture and "f_policies" not in registry.SQL[name]
