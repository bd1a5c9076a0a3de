"""Contiguous row numbers 0..n-1 under a declared order, without a one-task window.

Two exact ways, chosen by a check of the cell sizes:

* *cells*: the first order column is an integer, so arithmetic cuts its range into equal cells. A
  one-column count gives the rows of each cell; neighbouring cells become parts of a bounded number of rows,
  one task each however well the rows compress, and a part is sorted by the order itself.
* *range sort*: for other types, or when one cell holds too many rows (a hot key, a group of copies).
  Spark's range partitioner splits on all order columns plus a random tie-breaker, so even copies of one
  row are spread. The sorted table is written once; its partitions then give the offsets.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrail.sources.storage import store

ROWS_PER_PART = 250_000
MIN_PART_ROWS = 10_000
CELLS_PER_PART = 8
MAX_CELL_ROWS = 2_000_000
MIN_CELLS = 256
MAX_CELLS = 1 << 20
MAX_PARTITIONS = 1 << 16  # of the range sort; beyond, partitions get longer (they spill), the offsets on the driver do not
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the place inside the partition in its low 33 bits


def number_rows(
    df: DataFrame, order_by: list[str], name: str = "_row", max_cell_rows: int = MAX_CELL_ROWS
) -> DataFrame:
    """Add ``name``: the place of each row in the order. The order must be total up to equal rows."""
    if isinstance(df.schema[order_by[0]].dataType, _INTEGERS):
        numbered = _by_cells(df, order_by, name, max_cell_rows)
        if numbered is not None:
            return numbered
    return _by_range_sort(df, order_by, name)


def _by_cells(df: DataFrame, order_by: list[str], name: str, max_cell_rows: int) -> DataFrame | None:
    key = F.col(order_by[0]).cast("long")
    low, high, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if low is None or high - low >= 1 << 62:
        return None
    cells = min(MAX_CELLS, max(MIN_CELLS, math.ceil(n / ROWS_PER_PART) * CELLS_PER_PART))
    width = (high - low) // cells + 1
    cell = F.coalesce(F.expr(f"(cast(`{order_by[0]}` as bigint) - {low}L) div {width}L"), F.lit(-1))
    # at most MAX_CELLS + 1 counts reach the driver, whatever the table size
    counts = sorted(df.select(cell.alias("c")).groupBy("c").count().collect())
    if max(row["count"] for row in counts) > max_cell_rows:
        return None
    spark = df.sparkSession
    part_rows = min(ROWS_PER_PART, max(MIN_PART_ROWS, math.ceil(n / spark.sparkContext.defaultParallelism)))
    parts = _neighbours([row["count"] for row in counts], part_rows)
    places = spark.createDataFrame(
        [(row["c"], part, start) for row, (part, start) in zip(counts, parts)], "_cell bigint, _part int, _start bigint"
    )
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        df.withColumn("_cell", cell)
        .join(F.broadcast(places), "_cell")
        .drop("_cell")
        .repartitionById(parts[-1][0] + 1, F.col("_part"))
        .sortWithinPartitions(*order_by)
        .withColumn(name, F.col("_start") + inside)
        .drop("_part", "_start")
    )


def _neighbours(counts: list[int], part_rows: int) -> list[tuple[int, int]]:
    """For cells in order, their part and the rows before it; a part has ``part_rows`` rows at most, or is one cell."""
    out: list[tuple[int, int]] = []
    part = start = held = 0
    for n in counts:
        if held and held + n > part_rows:
            part, start, held = part + 1, start + held, 0
        out.append((part, start))
        held += n
    return out


def _by_range_sort(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    spark = df.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTITIONS, math.ceil(df.count() / ROWS_PER_PART))
    )
    keys = [*order_by, "_tie"]
    placed = store(
        df.withColumn("_tie", F.rand(7))
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_tie"),
        "numbered",
    )
    part = F.shiftright("_place", _LOCAL_BITS)
    counts = sorted(placed.groupBy(part.alias("c")).count().collect())  # one row per partition
    starts = [0, *accumulate(row["count"] for row in counts)]
    offsets = spark.createDataFrame(
        [(row["c"], start) for row, start in zip(counts, starts)], "_part bigint, _start bigint"
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_part", "_place", "_start")
    )
