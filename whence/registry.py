"""The queries of this library and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import causes, claims, fusion, ingest, intervals, measures, more, raw, streams, timelines, whatif, worlds  # noqa: F401  each adds its queries
from .plans.common import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which type of event most raises the chance of which later one?"""
    return QUERIES["pair_lift_topk"](spark, sf_dir)
