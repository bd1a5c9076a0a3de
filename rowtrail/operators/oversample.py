"""Row-making transformers: every class grown to the size of the largest, lineage included.

A copy keeps the ids of its row. A made row lies between two neighbours of its class and carries the ids of both. Rows of a class are
numbered along a curve through the feature space, and everything else is arithmetic on these places and joins on them: a place
belongs to one row, so no class, however large, meets in one task, and no pairs of a class are formed.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrail.functions import ids
from rowtrail.operators.joins import hidden_names
from rowtrail.operators.tracked import Tracked
from rowtrail.sources.numbering import number_rows
from rowtrail.sources.readers import hash_number
from rowtrail.sources.storage import store

CHUNK = 1 << 16  # rows made from one row of the plan
CURVE_BITS = 60


def _curve(df: DataFrame, features: list[str]) -> Column:
    """The place of a row on a Z-order curve: bits of the features, each cut into equal cells of its range, in turn. NULL is the lowest cell."""
    bits = min(16, CURVE_BITS // len(features))
    stats = df.agg(*[f(c).cast("double").alias(f"{i}{n}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    place = F.lit(0).cast("long")
    for i, c in enumerate(features):
        lo, hi = stats[f"{i}lo"] or 0.0, stats[f"{i}hi"] or 0.0
        share = (F.col(c).cast("double") - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        cell = F.coalesce(F.floor(share * ((1 << bits) - 1)).cast("long"), F.lit(0).cast("long"))
        for b in range(bits):
            place = place + F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1)), b * len(features) + i)
    return place


def _placed(t: Tracked, label: str, order: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_row``, their places by label and ``order``, and per class ``_class``, ``_first`` place, ``_n`` rows and ``_need``, the rows it lacks."""
    ordered = t.df.withColumns(order)
    placed = store(number_rows(ordered, [label, *order]).drop(*order), "placed")
    sizes = placed.groupBy(F.col(label).alias("_class")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    sizes = store(sizes, "sizes")
    most = sizes.agg(F.max("_n")).first()[0] or 0
    return placed, sizes.withColumn("_need", F.lit(most) - F.col("_n")).filter("_need > 0")


def _wanted(sizes: DataFrame) -> DataFrame:
    """One row per row to be made: its class's columns and ``_j``, counted from 0 in the class."""
    chunks = sizes.withColumn("_c", F.explode(F.expr(f"sequence(0L, (_need - 1) div {CHUNK}L)")))
    # spread before the long part, else one task would make all rows of a class
    chunks = chunks.repartition("_first", "_c")
    inside = F.expr(f"sequence(_c * {CHUNK}L, least((_c + 1) * {CHUNK}L, _need) - 1)")
    return chunks.withColumn("_j", F.explode(inside)).drop("_c")


def _key(t: Tracked, key: str | None) -> Column:
    return F.col(key).cast("string") if key else F.to_json(t.row_identity())


def copy_sample(t: Tracked, label: str, seed: int = 0, key: str | None = None, name: str = "made") -> Tracked:
    """Every class grown to the size of the largest by copies, all rows of a class as often as each other or once more.

    Those copied once more are the ones with the smallest hash of ``key``, which tells rows apart (default: their lineage). ``name`` counts
    the copies of a row from 1; it is 0 in the row itself. NULL labels are a class. Copies carry the ids of their row.
    """
    _check(t, label, [], name)
    row_key = _key(t, key)
    placed, sizes = _placed(t, label, {"_hash": hash_number(row_key, seed), "_key": row_key})
    made = _wanted(sizes).select((F.col("_first") + F.col("_j") % F.col("_n")).alias("_row"), F.expr("_j div _n + 1").alias(name))
    copies = placed.join(made, "_row")
    both = placed.withColumn(name, F.lit(0).cast("long")).unionByName(copies)
    return replace(t, df=both.select(*t.columns, name, *t.hidden), fresh=None, exact=False)


def neighbour_sample(
    t: Tracked, label: str, features: list[str], neighbours: int = 5, seed: int = 0, key: str | None = None, name: str = "made"
) -> Tracked:
    """Every class grown to the size of the largest by rows made between neighbours of the class.

    Neighbours are rows that follow each other along the order of a single feature, or of a Z-order curve through several (ties by ``key``,
    which tells rows apart; default: their lineage), the first following the last. Rows are taken in turn; in the k-th turn a row meets the one k places on, again from 1 after ``neighbours``. A made row has the
    first one's values but for ``features``, which lie a random share (a hash of both places and the count) of the way to the second's; NULL if
    the first's is NULL, the first's own if the second's is NULL. ``name`` is 0 for given rows and counts the made ones of a class from 1. A class of one row makes copies. NULL
    labels are a class. Made rows carry the ids of both parents, in hidden columns of their own.
    """
    _check(t, label, features, name)
    if not features or neighbours < 1:
        raise ValueError("give features and at least one neighbour")
    along = F.col(features[0]) if len(features) == 1 else _curve(t.df, features)
    placed, sizes = _placed(t, label, {"_along": along, "_key": _key(t, key)})
    step = F.expr(f"(_j div _n) % least({neighbours}L, greatest(_n - 1, 1L)) + 1")
    made = _wanted(sizes).withColumn("_at", F.col("_j") % F.col("_n"))
    made = made.select(
        (F.col("_first") + F.col("_at")).alias("_row"), (F.col("_first") + (F.col("_at") + step) % F.col("_n")).alias("_row2"), (F.col("_j") + 1).alias(name)
    )
    second_hidden = hidden_names(t, t)
    second = placed.select(
        F.col("_row").alias("_row2"), *[F.col(c).alias(f"_second{i}") for i, c in enumerate(features)], *[F.col(c).alias(n) for c, n in second_hidden.items()]
    )
    pairs = placed.join(made, "_row").join(second, "_row2")
    share = hash_number(F.concat_ws(":", "_row", "_row2", name), seed) / F.lit(float(1 << 32))
    between = {}
    for i, c in enumerate(features):
        a, b = F.col(c).cast("double"), F.col(f"_second{i}").cast("double")
        between[c] = F.coalesce(a + (b - a) * share, a)
    given = placed.withColumns({c: F.col(c).cast("double") for c in features}).withColumn(name, F.lit(0).cast("long"))
    given = given.withColumns({n: F.lit(None).cast(t.df.schema[c].dataType) for c, n in second_hidden.items()})
    columns = [*t.columns, name, *t.hidden, *second_hidden.values()]
    both = given.select(*columns).unionByName(pairs.withColumns(between).select(*columns))
    nodes = t.nodes | {second_hidden[c]: node for c, node in t.nodes.items()}
    return replace(t, df=both, nodes=nodes, fresh=None, exact=False)


def _check(t: Tracked, label: str, features: list[str], name: str) -> None:
    if missing := {label, *features} - set(t.columns):
        raise ValueError(f"no columns {sorted(missing)} among {t.columns}")
    if name in t.columns or ids.is_hidden(name):
        raise ValueError(f"{name} is taken: give another name for the count of made rows")
    if label in features:
        raise ValueError("the label is no feature")
