"""Aggregation of tracked frames.

The data side is a plain ``groupBy().agg()`` with map-side partial aggregation. The lineage side costs
nothing here: the result carries its group keys as a handle, and the input's (handle, ids) projection is
kept as a lazy plan to be read when lineage is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrail.functions import ids
from rowtrail.operators.tracked import GroupNode, Tracked, not_null

Function = str | Callable[[Column], Column]

FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),  # the sum of nothing is 0
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "nunique": F.countDistinct,
}


def aggregate(
    t: Tracked,
    keys: str | list[str] = (),
    spec: Function | list[Function] | dict | None = None,
    dropna: bool = True,
    **named: tuple[str, Function],
) -> Tracked:
    """Group by ``keys`` (none: the whole frame) and aggregate.

    ``spec`` may be one function for all other columns, a list of functions for all other columns (results
    ``<column>_<function>``), ``{column: function}``, ``{column: [functions]}``, ``{out: (column, function)}``
    or nothing; keyword arguments are ``out=(column, function)``. A function is a name of ``FUNCTIONS`` or
    a Spark function of a column. ``dropna`` leaves out rows with a NULL key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    df = not_null(t.df, keys) if dropna else t.df
    outputs = [
        _call(t, column, function).alias(out)
        for out, column, function in expand_spec(t.columns, keys, named or spec)
    ]
    grouped = df.groupBy(*keys)
    if outputs:
        result = grouped.agg(*outputs)
    else:
        result = grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return attach(t, df, keys, result, null_free=dropna)


def frequencies(t: Tracked, column: str, name: str = "count") -> Tracked:
    """How often each value of a column occurs."""
    df = not_null(t.df, [column])
    return attach(t, df, [column], df.groupBy(column).agg(F.count(F.lit(1)).alias(name)))


def expand_spec(columns: list[str], keys: list[str], spec) -> list[tuple[str, str, Function]]:
    """Every accepted form of an aggregate as (output name, input column, function)."""
    values = [c for c in columns if c not in keys]
    if spec is None:
        return []
    if isinstance(spec, list):
        return [(f"{c}_{_label(f)}", c, f) for c in values for f in spec]
    if not isinstance(spec, dict):
        return [(c, c, spec) for c in values]
    out = []
    for name, what in spec.items():
        if isinstance(what, tuple):
            out.append((name, *what))
        elif isinstance(what, list):
            out += [(f"{name}_{_label(f)}", name, f) for f in what]
        else:
            out.append((name, name, what))
    return out


def _label(function: Function) -> str:
    return function if isinstance(function, str) else function.__name__


def _call(t: Tracked, column: str, function: Function) -> Column:
    if column not in t.columns:
        raise ValueError(f"no column {column} among {t.columns}")
    if not isinstance(function, str):
        return function(F.col(column))
    if function not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {function}; known: {sorted(FUNCTIONS)}")
    if function in ("sum", "mean") and not isinstance(t.df.schema[column].dataType, T.NumericType):
        raise TypeError(f"{function} needs a numeric column, {column} is not; to join text use join_text")
    return FUNCTIONS[function](F.col(column))


def attach(t: Tracked, df: DataFrame, keys: list[str], result: DataFrame, null_free: bool = True) -> Tracked:
    """Give an aggregate's result its handle column and remember the rows behind each handle."""
    handle = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    node = GroupNode(
        number=t.trail.next_group(),
        keys=tuple(keys),
        inputs=df.select(handle.alias("_h"), *t.hidden),
        scalars=tuple(t.scalars),
        links=dict(t.nodes),
        exact=t.exact,
        null_free=null_free,
        numbered=t.exact and t.numbered,
    )
    column = f"{ids.GROUP_PREFIX}{node.number}"
    return replace(t, df=result.withColumn(column, handle), nodes={column: node}, fresh=node, exact=False)
