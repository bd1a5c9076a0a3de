"""Cutting groups of any size into parts of bounded size before anything is collected per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 1 << 16
BLOCK_BITS = 16
MAX_BROADCAST_GROUPS = 100_000


def in_parts(df: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``_part``: the rank of the row inside its group, by ``order``, divided by ``part_rows``; parts count from 0.

    The rule is the same for groups of every size. Ranks are counted in two steps, so no window spans a group: rows are ranked inside
    blocks of 65,536 values of the first order column, a whole number, and the blocks of a group are added up. Where that column repeats
    inside a group a block may hold more rows; ranks stay right, and a part never holds more than ``part_rows`` rows.
    """
    block = F.shiftright(F.coalesce(F.col(order[0]), F.lit(-1).cast("long")), BLOCK_BITS)
    df = df.withColumn("_block", block)
    counts = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "_block"])}
    counts = counts.select(
        *[F.col(k).alias(n) for k, n in names.items()], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    match = F.lit(True)
    for k, n in names.items():
        match = match & F.col(k).eqNullSafe(F.col(n))
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    placed = df.join(counts, match).withColumn("_part", F.floor((F.col("_before") + rank) / part_rows).cast("long"))
    return placed.drop("_block", "_before", *names.values())


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group, from one count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
