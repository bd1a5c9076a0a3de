"""The register of queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrail.operators import lineage
from rowtrail.operators.tracked import Tracked
from rowtrail.plans.shop import Shop

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(shop) -> DataFrame`` under ``name``."""

    def add(function: Callable[[Shop], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Shop(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def shown(t: Tracked) -> DataFrame:
    """The data with its decoded lineage as text: ``prov_n`` ids, ``prov`` the tokens."""
    full = lineage.decoded(t)
    return full.select(
        *t.columns,
        F.size("_prov").cast("long").alias("prov_n"),
        F.array_join("_prov", ",").alias("prov"),
    )


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
