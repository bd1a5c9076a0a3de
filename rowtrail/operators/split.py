"""Train/test splits, folds and class balancing, decided by a hash of each row's own key.

The same rows land on the same side in every run and under every partitioning. Ids ride along.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtrail.operators.parts import MAX_BROADCAST_GROUPS
from rowtrail.operators.tracked import Tracked
from rowtrail.sources.readers import hash_number
from rowtrail.sources.storage import store

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKET_BITS = 20


def _row_key(t: Tracked, key: str | None) -> Column:
    return F.col(key).cast("string") if key else F.to_json(t.row_identity())


def train_test_split(
    t: Tracked, test_fraction: float = 0.25, seed: int = 0, key: str | None = None
) -> tuple[Tracked, Tracked]:
    """Rows whose hash falls below the fraction are test rows. ``key`` defaults to the lineage of the row."""
    in_test = hash_number(_row_key(t, key), seed) < F.lit(int(test_fraction * (1 << 32)))
    return t.filter(~in_test), t.filter(in_test)


def with_folds(t: Tracked, folds: int, seed: int = 0, key: str | None = None, name: str = "fold") -> Tracked:
    return t.with_columns({name: (hash_number(_row_key(t, key), seed) % folds).cast("int")})


def stratified_split(
    t: Tracked, label: str, test_fraction: float = 0.2, seed: int = 0, key: str | None = None
) -> tuple[Tracked, Tracked]:
    """In every class exactly round(fraction * size) rows, those with the smallest hashes, are test rows."""
    wanted = F.floor(F.col("size") * test_fraction + 0.5)
    chosen = _smallest_hashes(t, label, wanted, seed, key)
    return chosen(False), chosen(True)


def under_sample(t: Tracked, label: str, seed: int = 0, key: str | None = None) -> Tracked:
    """As many rows of every class as the smallest class has: those with the smallest hashes."""
    return _smallest_hashes(t, label, F.col("smallest"), seed, key)(True)


def _smallest_hashes(t: Tracked, label: str, wanted: Column, seed: int, key: str | None):
    """A function: True gives the ``wanted`` rows of each class with the smallest hash, False the others.

    Only counts per (class, leading hash bits) are ordered; rows are ranked in just the one bucket per class in
    which the limit falls, so no window spans a class. Each side is then one filter over the rows.
    """
    row_key = _row_key(t, key)
    hashed = t.df.withColumn("_key", row_key).withColumn("_hash", hash_number(row_key, seed))
    sizes = t.df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("size"))
    n, smallest, classes = sizes.agg(F.sum("size"), F.min("size"), F.count(F.lit(1))).first()
    bits = min(MAX_BUCKET_BITS, max(4, math.ceil(math.log2(max(1, (n or 1) / ROWS_PER_BUCKET)))))
    hashed = hashed.withColumn("_bucket", F.shiftright("_hash", 32 - bits))

    counts = hashed.groupBy(F.col(label).alias("_label"), "_bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    targets = sizes.withColumn("smallest", F.lit(smallest)).select("_label", wanted.cast("long").alias("_want"))
    targets = targets.withColumnRenamed("_label", "_class")
    filled = counts.withColumn("_upto", F.sum("n").over(upto)).join(
        targets, F.col("_label").eqNullSafe(F.col("_class"))
    )
    limits = (
        filled.filter(F.col("_upto") >= F.col("_want"))
        .groupBy("_class")
        .agg(F.min(F.struct("_bucket", (F.col("_want") - F.col("_upto") + F.col("n")).alias("need"))).alias("l"))
        .select("_class", F.col("l._bucket").alias("_limit"), F.col("l.need").alias("_need"))
    )
    # the last row taken of each class: ranked in just the bucket in which the limit falls; one row per class
    border = hashed.select(F.col(label).alias("_label"), "_bucket", "_hash", "_key").join(
        F.broadcast(limits) if classes <= MAX_BROADCAST_GROUPS else limits, F.col("_label").eqNullSafe(F.col("_class"))
    )
    border = border.filter(F.col("_bucket") == F.col("_limit"))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_hash", "_key"))
    last = border.withColumn("_rank", rank).filter(F.col("_rank") == F.col("_need"))
    last = store(last.select("_class", F.col("_hash").alias("_last_hash"), F.col("_key").alias("_last_key")), "limits")
    if classes <= MAX_BROADCAST_GROUPS:
        last = F.broadcast(last)
    columns = t.df.columns
    placed = hashed.join(last, F.col(label).eqNullSafe(F.col("_class")), "left")
    earlier = F.struct("_hash", "_key") <= F.struct("_last_hash", "_last_key")
    taken = F.coalesce(F.col("_last_hash").isNotNull() & earlier, F.lit(False))

    def pick(take: bool) -> Tracked:
        df: DataFrame = placed.filter(taken if take else ~taken).select(*columns)
        return replace(t, df=df, fresh=None)

    return pick
