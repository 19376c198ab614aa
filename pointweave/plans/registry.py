"""How a query and the SQL that must agree with it are registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointweave.sources import fixtures


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None, *doubles: str) -> None:
        """``build`` gets a function from view or table names to DataFrames."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fixtures.rounded(build(lambda view: fixtures.view(spark, sf_dir, view)))

        self.queries[name] = query
        if sql is not None:
            self.oracles[name] = fixtures.duck(sql, *doubles)


catalog = Catalog()
add = catalog.add
