"""k steps of (left join with a lookup, group by), the shape that grows lineage fastest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail import Trail, aggregate, join
from rowtrail.operators.tracked import Tracked
from rowtrail.sources.storage import store


def chain(trail: Trail, fact: Tracked, lookup: DataFrame, steps: int, store_every: int = 1) -> Tracked:
    """``fact`` has category and user_id, ``lookup`` has user_id, country and a row number ``lookup_row``.

    Each step's joined rows are written before they are grouped: the result and the lineage of the step both
    read them, and the plan of the next step starts from them.
    """
    t = fact
    for i in range(steps):
        side = trail.source(lookup, f"lookup{i}", row_key="lookup_row", unique=True).select("user_id", "country")
        t = join(t, side, on="user_id", how="left").select("category", "user_id", "country")
        if (i + 1) % store_every == 0:
            t = t.stored(f"step{i}")
        t = aggregate(t, ["category", "user_id"], country_count=("country", "count"))
    return t


def plain_chain(fact: DataFrame, lookup: DataFrame, steps: int, store_every: int = 1) -> DataFrame:
    """The same without lineage, for comparison."""
    df = fact
    side = lookup.select("user_id", "country")
    for i in range(steps):
        df = df.select("category", "user_id").join(side, "user_id", "left")
        if (i + 1) % store_every == 0:
            df = store(df, f"plain{i}")
        df = df.groupBy("category", "user_id").agg(F.count("country").alias("country_count"))
    return df


def shop_chain_inputs(shop) -> tuple[Tracked, DataFrame]:
    """Orders as the fact table, customers as the lookup."""
    fact = shop.tracked("orders", "o_orderkey").rename({"o_orderpriority": "category", "o_custkey": "user_id"})
    lookup = shop.table("customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("country"), F.col("c_custkey").alias("lookup_row")
    )
    return fact.select("category", "user_id"), lookup
