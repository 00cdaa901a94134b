"""All queries of the package, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import bodies, stores  # noqa: F401 (they add their queries)
from .plans import queries as plans

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.flagship(spark, sf_dir)
