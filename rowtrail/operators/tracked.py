"""A DataFrame whose rows know where they came from.

Two kinds of hidden column carry the lineage:

* ``_prov<table>``   BIGINT, the packed id of one contributing row of a source table (NULL: none);
* ``_provg<number>`` STRUCT, the keys of an aggregate's group (NULL: none). The rows behind the group
  stay where they are: ``nodes`` maps the column to a projection of the aggregate's input. No array of
  ids is ever built while data flows, so a group may hold any share of the table.

Hidden columns are ordinary columns: Catalyst carries them through filters and joins, and prunes them
from every plan that does not ask for lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrail.functions import ids
from rowtrail.sources.storage import store

if TYPE_CHECKING:
    from rowtrail.sources.trail import Trail

FLOATS = (T.FloatType, T.DoubleType)


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL (or NaN) in ``columns``, as conditions that scans can take over."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
        if isinstance(df.schema[c].dataType, FLOATS):
            df = df.filter(~F.isnan(c))
    return df


@dataclass(frozen=True)
class GroupNode:
    """The input side of one aggregate: group keys ``_h`` beside the hidden columns of each input row."""

    number: int
    keys: tuple[str, ...]
    inputs: DataFrame
    scalars: tuple[str, ...]
    links: dict[str, "GroupNode"]
    exact: bool  # every input row carries exactly one id, and no two rows the same one
    null_free: bool  # no key is NULL
    numbered: bool = False  # exact, and not by declaration: the ids were assigned row by row


@dataclass(frozen=True)
class Tracked:
    df: DataFrame
    trail: "Trail"
    nodes: dict[str, GroupNode] = field(default_factory=dict)
    fresh: GroupNode | None = None  # rows are exactly the groups of this node, keys untouched
    exact: bool = False  # one id column, unique per row
    numbered: bool = False  # the first table's ids were assigned row by row; with ``exact`` they cannot repeat

    # -- columns -----------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not ids.is_hidden(c)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if ids.is_hidden(c)]

    @property
    def scalars(self) -> list[str]:
        return [c for c in self.hidden if c not in self.nodes]

    def untracked(self) -> DataFrame:
        """The data alone."""
        return self.df.select(*self.columns)

    def raw(self) -> DataFrame:
        """The hidden columns alone."""
        return self.df.select(*self.hidden)

    def row_identity(self) -> Column:
        return F.struct(*self.hidden)

    # -- projection ----------------------------------------------------------------------------------

    def select(self, *columns: str) -> "Tracked":
        return replace(self, df=self.df.select(*columns, *self.hidden), fresh=self._fresh_with(columns))

    def drop(self, *columns: str) -> "Tracked":
        return self.select(*[c for c in self.columns if c not in columns])

    def rename(self, names: dict[str, str]) -> "Tracked":
        self._check_names(names.values())
        kept = self.fresh if self.fresh and not set(names) & set(self.fresh.keys) else None
        return replace(self, df=self.df.withColumnsRenamed(names), fresh=kept)

    def with_columns(self, columns: dict[str, Column | Callable[[DataFrame], Column]]) -> "Tracked":
        """Add or replace columns; an expression may be a function of the frame."""
        self._check_names(columns)
        exprs = {n: e(self.df) if not isinstance(e, Column) and callable(e) else e for n, e in columns.items()}
        kept = self.fresh if self.fresh and not set(columns) & set(self.fresh.keys) else None
        return replace(self, df=self.df.withColumns(exprs), fresh=kept)

    # -- selection -----------------------------------------------------------------------------------

    def filter(self, condition: Column | str) -> "Tracked":
        return replace(self, df=self.df.filter(condition), fresh=None)

    def where_in(self, column: str, values: list | DataFrame) -> "Tracked":
        """Membership; a one-column DataFrame of values becomes a left-semi join."""
        if isinstance(values, DataFrame):
            wanted = values.toDF("_wanted")
            kept = self.df.join(wanted, F.col(column) == F.col("_wanted"), "left_semi")
            return replace(self, df=kept, fresh=None)
        return self.filter(F.col(column).isin(values))

    def drop_nulls(self, subset: list[str] | None = None) -> "Tracked":
        return replace(self, df=not_null(self.df, subset or self.columns), fresh=None)

    def head(self, n: int) -> "Tracked":
        """The first ``n`` rows in the order of their ids."""
        return replace(self, df=self.df.orderBy(*self.hidden).limit(n), fresh=None)

    def first_per_key(self, keys: list[str]) -> "Tracked":
        """Per key the whole row with the smallest ids; NULL counts as a key. Its lineage is that row's."""
        if self.exact and len(self.hidden) == 1:
            # one unique id per row: the smallest of each key by a hash aggregate, the rows by a semi-join on it
            column = self.hidden[0]
            least = self.df.groupBy(*keys).agg(F.min(column).alias("_first")).select("_first")
            kept = self.df.join(least, F.col(column) == F.col("_first"), "left_semi")
            return replace(self, df=kept, fresh=None)
        first = F.min_by(F.struct(*self.df.columns), self.row_identity()).alias("_row")
        kept = self.df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first)
        return replace(self, df=kept.select("_row.*"), fresh=None)

    # -- cleaning --------------------------------------------------------------------------------------

    def fill_nulls(self, values: dict[str, object]) -> "Tracked":
        """Constants, or columns of the frame, for NULLs."""
        exprs = {c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()}
        return self.with_columns(exprs)

    def fill_with_scalar(self, column: str, scalar: DataFrame) -> "Tracked":
        """Fill NULLs from a one-row, one-column aggregate. The value is a constant, it adds no ids."""
        return self.with_columns({column: F.coalesce(F.col(column), scalar.toDF("value").scalar())})

    def infinite_to_null(self) -> "Tracked":
        floats = [c for c in self.columns if isinstance(self.df.schema[c].dataType, FLOATS)]
        return self.with_columns({c: F.when(F.abs(c) != float("inf"), F.col(c)) for c in floats})

    # -- materialisation ---------------------------------------------------------------------------------

    def stored(self, label: str = "rows") -> "Tracked":
        """Write the rows to the shared folder once and go on from there: for frames that are read many times,
        as by fits, and for long chains of operators."""
        return replace(self, df=store(self.df, label))

    def dealt(self, tasks: int, *columns: str) -> "Tracked":
        """Deal the rows out by ``columns`` to so many tasks, as many as were asked for however well the rows compress: for
        rows that are few per key, as groups are, before a join on it."""
        return replace(self, df=self.df.repartition(tasks, *columns))

    # -- user operators ---------------------------------------------------------------------------------

    def apply(self, operator: str, *args, **kwargs) -> "Tracked":
        """Run a registered operator; it must hand back a tracked frame."""
        out = _OPERATORS[operator](self, *args, **kwargs)
        if not isinstance(out, Tracked):
            raise TypeError(f"operator {operator} lost the lineage: it returned {type(out).__name__}")
        return out

    def _fresh_with(self, columns) -> GroupNode | None:
        return self.fresh if self.fresh and set(self.fresh.keys) <= set(columns) else None

    def _check_names(self, names) -> None:
        bad = [n for n in names if ids.is_hidden(n)]
        if bad:
            raise ValueError(f"column names starting with {ids.PREFIX} are reserved: {bad}")


_OPERATORS: dict[str, Callable[..., Tracked]] = {}


def register_operator(name: str, function: Callable[..., Tracked]) -> None:
    """Make ``function(tracked, ...) -> tracked`` callable as ``tracked.apply(name, ...)``."""
    _OPERATORS[name] = function
