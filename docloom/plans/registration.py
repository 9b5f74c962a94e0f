"""Queries as functions of fixtures, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.fixtures import duck, spark_fixtures


class Registry:
    """Collects queries by their function's name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None, *fixtures: str):
        """Register a function of the named fixtures; ``sql`` is None where SQL can't say it."""

        def register(function):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return function(*spark_fixtures(spark, sf_dir, fixtures))

            run.__doc__, run.__name__ = function.__doc__, function.__name__
            self.queries[function.__name__] = run
            if sql is not None:
                self.sql[function.__name__] = duck(sql)
            return function

        return register
