"""Registry of the library's queries and of the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointweave.plans import fusion_queries, geometry_queries, mesh_queries, pipeline_queries, spatial_queries, stream_queries, table_queries  # noqa: F401
from pointweave.plans.registry import catalog


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuse repeated predictions per point, then report metrics per threshold."""
    return catalog.queries["l5_fuse_points"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.queries)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.oracles)
