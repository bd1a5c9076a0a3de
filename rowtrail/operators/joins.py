"""Equi-joins of tracked frames; the ids of both sides stay."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from rowtrail.operators.tracked import Tracked

HOW = ("inner", "left", "right")


def join(
    left: Tracked,
    right: Tracked,
    on: str | list[str] | None = None,
    left_on: str | list[str] | None = None,
    right_on: str | list[str] | None = None,
    how: str = "inner",
    suffixes: tuple[str, str] | None = None,
    null_keys: str = "drop",
) -> Tracked:
    """Join on equal keys.

    ``on`` keeps one copy of the key; ``left_on``/``right_on`` keep both. Other columns with the same name
    on both sides need ``suffixes``. ``null_keys="match"`` lets NULL keys meet each other.
    The physical join is left to Spark: broadcast when statistics prove a side small, else sort-merge with
    adaptive splitting of skewed keys.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    same_trail(left, right)
    shared = [on] if isinstance(on, str) else list(on or [])
    left_keys = shared or ([left_on] if isinstance(left_on, str) else list(left_on))
    right_keys = shared or ([right_on] if isinstance(right_on, str) else list(right_on))

    left_names, right_names = _data_names(left, right, shared, suffixes)
    right_hidden = hidden_names(left, right)
    key_names = {k: f"_key{i}" for i, k in enumerate(shared)}

    left_df = left.df.select(
        *[F.col(c).alias(left_names[c]) for c in left.columns], *left.hidden
    )
    right_df = right.df.select(
        *[F.col(c).alias(right_names.get(c, key_names.get(c))) for c in right.columns],
        *[F.col(c).alias(right_hidden[c]) for c in right.hidden],
    )
    pairs = [
        (F.col(left_names[lk]), F.col(key_names.get(rk) or right_names[rk]))
        for lk, rk in zip(left_keys, right_keys)
    ]
    match = [a.eqNullSafe(b) if null_keys == "match" else a == b for a, b in pairs]
    joined = left_df.join(right_df, reduce(lambda a, b: a & b, match), how)

    def left_value(c: str):
        from_right = how == "right" and c in shared
        return F.col(key_names[c]).alias(c) if from_right else F.col(left_names[c])

    df = joined.select(
        *[left_value(c) for c in left.columns],
        *[right_names[c] for c in right.columns if c not in shared],
        *left.hidden,
        *[right_hidden[c] for c in right.hidden],
    )
    nodes = left.nodes | {right_hidden[c]: node for c, node in right.nodes.items()}
    return replace(left, df=df, nodes=nodes, fresh=None, exact=False)


def same_trail(left: Tracked, right: Tracked) -> None:
    """Ids of two trails mean different tables under the same numbers: such frames never meet."""
    if left.trail is not right.trail:
        raise ValueError("the two frames belong to different trails; register both tables in one Trail")


def _data_names(left, right, shared, suffixes) -> tuple[dict[str, str], dict[str, str]]:
    clash = (set(left.columns) & set(right.columns)) - set(shared)
    if clash and suffixes is None:
        raise ValueError(f"both sides have columns {sorted(clash)}: give suffixes")
    ls, rs = suffixes or ("", "")
    left_names = {c: c + ls if c in clash else c for c in left.columns}
    right_names = {c: c + rs if c in clash else c for c in right.columns if c not in shared}
    out = [*left_names.values(), *right_names.values()]
    if len(set(out)) < len(out):
        raise ValueError(f"suffixes {suffixes} leave duplicate column names")
    return left_names, right_names


def hidden_names(left: Tracked, right: Tracked) -> dict[str, str]:
    """Names for the right side's hidden columns; a source met before gets a numbered second column."""
    taken, names = set(left.hidden), {}
    for column in right.hidden:
        base, n, name = column.split("__")[0], 0, column
        while name in taken:
            n += 1
            name = f"{base}__{n}"
        taken.add(name)
        names[column] = name
    return names
