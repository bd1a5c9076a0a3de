"""Imputers and scalers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowtrail.features.base import ColumnwiseTransformer
from rowtrail.functions.quantiles import exact_quantiles
from rowtrail.operators.tracked import Tracked


class MedianImputer(ColumnwiseTransformer):
    """NULLs become the exact median of the training rows."""

    def fit(self, t: Tracked) -> "MedianImputer":
        quantiles = exact_quantiles(t.df, self.columns, [0.5])
        self.medians = {c: quantiles[c][0] for c in self.columns}
        return self

    def transform(self, t: Tracked) -> Tracked:
        return t.with_columns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")) for c, m in self.medians.items()}
        )


class MostFrequentImputer(ColumnwiseTransformer):
    """NULLs become the most frequent value, of equally frequent ones the smallest."""

    def fit(self, t: Tracked) -> "MostFrequentImputer":
        self.values = {}
        for c in self.columns:
            counts = t.df.select(c).na.drop().groupBy(c).count()
            top = counts.orderBy(F.desc("count"), c).first()
            self.values[c] = top[0] if top else None
        return self

    def transform(self, t: Tracked) -> Tracked:
        return t.fill_nulls({c: v for c, v in self.values.items() if v is not None})


class StandardScaler(ColumnwiseTransformer):
    """(x - mean) / population standard deviation; a constant column is only shifted."""

    def fit(self, t: Tracked) -> "StandardScaler":
        row = t.df.agg(
            *[f(c).alias(f"{c}:{n}") for c in self.columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
        ).first()
        self.stats = {c: (row[f"{c}:mean"] or 0.0, row[f"{c}:std"] or 1.0) for c in self.columns}
        return self

    def transform(self, t: Tracked) -> Tracked:
        return t.with_columns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})


class RobustScaler(ColumnwiseTransformer):
    """(x - median) / interquartile range; a range of 0 only shifts."""

    def fit(self, t: Tracked) -> "RobustScaler":
        quantiles = exact_quantiles(t.df, self.columns, [0.25, 0.5, 0.75])
        self.stats = {}
        for c, (q1, median, q3) in quantiles.items():
            self.stats[c] = (0.0, 1.0) if median is None else (median, (q3 - q1) or 1.0)
        return self

    def transform(self, t: Tracked) -> Tracked:
        return t.with_columns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})


class SquashingScaler(ColumnwiseTransformer):
    """Robust scaling followed by the soft clip z / sqrt(1 + (z/B)^2), so results stay in (-B, B).

    Quartiles are those of the finite values. Where they coincide, 2/(max - min) takes the place of
    1/IQR; a constant column gives 0. Infinite values give -B and B.
    """

    def __init__(self, columns: list[str], bound: float = 3.0):
        super().__init__(columns)
        self.bound = bound

    def fit(self, t: Tracked) -> "SquashingScaler":
        finite = t.df.select(*[F.when(F.abs(c) != math.inf, F.col(c).cast("double")).alias(c) for c in self.columns])
        quantiles = exact_quantiles(finite, self.columns, [0.25, 0.5, 0.75])
        ends = finite.agg(
            *[f(c).alias(f"{c}:{n}") for c in self.columns for n, f in (("lo", F.min), ("hi", F.max))]
        ).first()
        self.stats = {}
        for c, (q1, median, q3) in quantiles.items():
            if median is None:
                self.stats[c] = (0.0, 0.0)
                continue
            low, high = ends[f"{c}:lo"], ends[f"{c}:hi"]
            factor = 1 / (q3 - q1) if q3 > q1 else 2 / (high - low) if high > low else 0.0
            self.stats[c] = (median, factor)
        return self

    def transform(self, t: Tracked) -> Tracked:
        return t.with_columns({c: self._squash(c, *stats) for c, stats in self.stats.items()})

    def _squash(self, column: str, median: float, factor: float) -> Column:
        x = F.col(column).cast("double")
        z = (x - F.lit(median)) * F.lit(factor)
        soft = z / F.sqrt(1 + (z / self.bound) * (z / self.bound))
        return (
            F.when(x == math.inf, F.lit(self.bound)).when(x == -math.inf, F.lit(-self.bound)).otherwise(soft)
        )
