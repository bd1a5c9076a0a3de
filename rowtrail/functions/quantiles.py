"""Exact quantiles of columns of any size.

Spark's exact ``percentile`` keeps every distinct value of a column in one task. It is used only after a
count shows that few distinct values exist. Beyond that the wanted order statistics are closed in:
``percentile_approx`` proposes a bracket, a counting pass checks it, and when the bracket holds few distinct
values their counts settle the rank. All columns share each pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_DISTINCT = 1_000_000
SETTLE_DISTINCT = 50_000
ACCURACY = 10_000
MAX_ROUNDS = 64


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    small_distinct: int = SMALL_DISTINCT,
    settle_distinct: int = SETTLE_DISTINCT,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, NULLs left out; None for columns without values."""
    if not columns:
        return {}
    sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    small = [c for c in columns if sizes[c] <= small_distinct]
    large = [c for c in columns if sizes[c] > small_distinct]
    out: dict[str, list[float | None]] = {}
    if small:
        wanted = F.array(*[F.lit(p) for p in probabilities])
        row = df.agg(*[F.percentile(c, wanted).alias(c) for c in small]).first()
        out |= {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in small}
    if large:
        out |= _closed_in(df, large, probabilities, settle_distinct)
    return out


@dataclass
class _Rank:
    column: str
    rank: int
    low: float
    high: float
    proposed: tuple[float, float] | None = None
    value: float | None = None

    def inside(self) -> Column:
        return F.col(self.column).between(self.low, self.high)


def _closed_in(df: DataFrame, columns: list[str], probabilities: list[float], settle: int) -> dict[str, list[float]]:
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ends = df.agg(*[f(c).alias(f"{c}:{n}") for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    place = {(c, p): (ends[f"{c}:n"] - 1) * p for c in columns for p in probabilities}
    ranks = {
        (c, k): _Rank(c, k, ends[f"{c}:lo"], ends[f"{c}:hi"])
        for (c, _), at in place.items()
        for k in (math.floor(at), math.ceil(at))
    }
    for _ in range(MAX_ROUNDS):
        waiting = [r for r in ranks.values() if r.value is None]
        if not waiting:
            break
        _one_round(df, waiting, settle)
    else:
        raise RuntimeError("quantiles did not settle")

    def value(c: str, p: float) -> float:
        at = place[c, p]
        low, high = ranks[c, math.floor(at)].value, ranks[c, math.ceil(at)].value
        return low + (high - low) * (at - math.floor(at))

    return {c: [value(c, p) for p in probabilities] for c in columns}


def _one_round(df: DataFrame, ranks: list[_Rank], settle: int) -> None:
    counts = df.agg(
        *[F.count(F.when(F.col(r.column) < r.low, 1)).alias(f"below{i}") for i, r in enumerate(ranks)],
        *[F.count(F.when(r.inside(), 1)).alias(f"inside{i}") for i, r in enumerate(ranks)],
        *[F.approx_count_distinct(F.when(r.inside(), F.col(r.column))).alias(f"kinds{i}") for i, r in enumerate(ranks)],
    ).first()
    ready, wide = [], []
    for i, r in enumerate(ranks):
        (ready if counts[f"kinds{i}"] <= settle or r.low == r.high else wide).append(i)
    if ready:
        hits = F.array_compact(
            F.array(*[F.when(ranks[i].inside(), F.struct(F.lit(i).alias("i"), F.col(ranks[i].column).alias("v"))) for i in ready])
        )
        # few distinct values per rank, as just counted
        table = df.select(F.explode(hits).alias("h")).groupBy("h.i", "h.v").count().collect()
        for i in ready:
            seen = counts[f"below{i}"]
            for v, n in sorted((row["v"], row["count"]) for row in table if row["i"] == i):
                seen += n
                if ranks[i].rank < seen:
                    ranks[i].value = v
                    break
    if wide:
        def around(i: int) -> Column:
            q = (ranks[i].rank - counts[f"below{i}"]) / max(1, counts[f"inside{i}"] - 1)
            ends = [min(1.0, max(0.0, q + d)) for d in (-2 / ACCURACY, 2 / ACCURACY)]
            return F.percentile_approx(F.when(ranks[i].inside(), F.col(ranks[i].column)), ends, ACCURACY)

        proposals = df.agg(*[around(i).alias(f"p{i}") for i in wide]).first()
        bounds = {i: tuple(proposals[f"p{i}"]) for i in wide}
        check = df.agg(
            *[F.count(F.when(F.col(ranks[i].column) < bounds[i][0], 1)).alias(f"below{i}") for i in wide],
            *[F.count(F.when(F.col(ranks[i].column) <= bounds[i][1], 1)).alias(f"upto{i}") for i in wide],
        ).first()
        for i in wide:
            r, (low, high) = ranks[i], bounds[i]
            if r.rank < check[f"below{i}"]:
                r.high = low
            elif r.rank >= check[f"upto{i}"]:
                r.low = high
            else:
                r.low, r.high = low, high
