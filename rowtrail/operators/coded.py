"""Id sets of any size, one row per output row.

A set is a list of buckets of 32,768 row numbers of one table. A bucket with few ids lists their places, two bytes each; any other is a bitmap of 4 KB. So a group
that holds a third of a table of n rows takes n / 8 bytes at most, and one of a few ids a few bytes. Buckets are built and merged by Spark's own bitmap
aggregates, per (group, table, bucket): a hot group is many small aggregates, and only its finished buckets come together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrail.functions import ids
from rowtrail.operators.lineage import edges
from rowtrail.operators.parts import MAX_BROADCAST_GROUPS
from rowtrail.operators.tracked import Tracked
from rowtrail.sources.storage import store

BUCKET = 1 << 15  # fixed value: bits of Spark's bitmaps
LISTED = 1024
"""A bucket with at most so many ids lists them."""


def coded_sets(t: Tracked, keys: list[str]) -> DataFrame:
    """(keys…, _sets, _n): the ids behind each output row, and how many they are. ``_sets`` is ordered by table and bucket. A row without lineage is left out."""
    found = edges(t, keys).select(
        F.struct(*keys).alias("_k"), "table_id", F.floor(F.col("row_id") / BUCKET).alias("bucket"), (F.col("row_id") % BUCKET).alias("place")
    )
    found = store(found, "places")
    return _whole(_buckets(found, F.count(F.lit(1))), keys)


def _buckets(places: DataFrame, size: Column) -> DataFrame:
    """(_k, table_id, bucket, listed, bits) from (_k, table_id, bucket, place)."""
    at = ["_k", "table_id", "bucket"]
    crowded = store(places.groupBy(*at).agg(size.alias("n")).filter(F.col("n") > LISTED).drop("n"), "crowded")
    side = F.broadcast(crowded) if crowded.count() <= MAX_BROADCAST_GROUPS else crowded
    bits = places.join(side, at, "left_semi").groupBy(*at).agg(F.bitmap_construct_agg("place").alias("bits"))
    listed = places.join(side, at, "left_anti").groupBy(*at).agg(F.array_sort(F.collect_set(F.col("place").cast("short"))).alias("listed"))
    none = {"listed": F.lit(None).cast("array<short>"), "bits": F.lit(None).cast("binary")}
    columns = [*at, "listed", "bits"]
    return bits.withColumn("listed", none["listed"]).select(*columns).unionByName(listed.withColumn("bits", none["bits"]).select(*columns))


def _whole(buckets: DataFrame, keys: list[str]) -> DataFrame:
    n = F.when(F.col("bits").isNotNull(), F.bitmap_count("bits")).otherwise(F.size("listed").cast("long"))
    part = F.struct("table_id", "bucket", n.alias("n"), "listed", "bits")
    sets = buckets.groupBy("_k").agg(F.array_sort(F.collect_list(part), _in_order).alias("_sets"), F.sum(n).alias("_n"))
    return sets.select(*[F.col("_k")[k].alias(k) for k in keys], "_sets", "_n")


def _in_order(x: Column, y: Column) -> Column:
    a, b = F.struct(x["table_id"], x["bucket"]), F.struct(y["table_id"], y["bucket"])
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def merged_sets(coded: DataFrame, keys: list[str]) -> DataFrame:
    """The unions of coded sets by fewer ``keys``, without going back to the ids: bitmaps are or-ed, lists joined while they stay short."""
    at = ["_k", "table_id", "bucket"]
    rows = coded.select(F.struct(*keys).alias("_k"), F.explode("_sets").alias("s")).select("_k", "s.*")
    rows = store(rows, "sets")
    crowded = rows.groupBy(*at).agg(F.sum("n").alias("n"), F.count("bits").alias("b")).filter((F.col("n") > LISTED) | (F.col("b") > 0))
    crowded = store(crowded.select(*at), "crowded")
    side = F.broadcast(crowded) if crowded.count() <= MAX_BROADCAST_GROUPS else crowded
    together = rows.join(side, at, "left_semi")
    spread = together.filter("bits IS NULL").select(*at, F.explode(F.col("listed").cast("array<bigint>")).alias("place"))
    bits = spread.groupBy(*at).agg(F.bitmap_construct_agg("place").alias("bits")).unionByName(together.filter("bits IS NOT NULL").select(*at, "bits"))
    bits = bits.groupBy(*at).agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("listed", F.lit(None).cast("array<short>"))
    short = rows.join(side, at, "left_anti").select(*at, F.explode("listed").alias("place"))
    short = short.groupBy(*at).agg(F.array_sort(F.collect_set("place")).alias("listed")).withColumn("bits", F.lit(None).cast("binary"))
    return _whole(bits.select(*at, "listed", "bits").unionByName(short.select(*at, "listed", "bits")), keys)


def _places(bits: pa.Array) -> pa.Array:
    """The places of the bits that are set."""
    found = [np.flatnonzero(np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), bitorder="little")) if b.is_valid else np.zeros(0, np.int64) for b in bits]
    bounds = np.append(0, np.cumsum([len(x) for x in found]))
    flat = np.concatenate(found) if found else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))


def decoded_sets(coded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, table_id, row_id): the edges that coded sets stand for, a bucket at a time."""
    buckets = coded.select(*keys, F.explode("_sets").alias("s")).select(*keys, "s.*")
    columns = [*keys, "table_id", "bucket", F.explode("places").alias("place")]
    listed = buckets.filter("bits IS NULL").withColumn("places", F.col("listed").cast("array<int>")).select(*columns)
    dense = buckets.filter("bits IS NOT NULL").withColumn("places", F.arrow_udf(_places, "array<int>")("bits")).select(*columns)
    row = F.col("bucket") * BUCKET + F.col("place")
    return listed.unionByName(dense).select(*keys, "table_id", row.cast("long").alias("row_id"))


def packed_id(table: str = "table_id", row: str = "row_id") -> Column:
    """The packed id of a decoded edge."""
    return F.shiftleft(F.col(table).cast("long"), ids.ROW_BITS).bitwiseOR(F.col(row))
