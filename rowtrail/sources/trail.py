"""The register of named tables, and the step that gives a table its row ids."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrail.functions import ids
from rowtrail.operators.tracked import Tracked
from rowtrail.sources.numbering import number_rows


class Trail:
    """Table names and numbers of one lineage space. Numbers follow the order of registration."""

    def __init__(self, tables: list[str] | None = None):
        self._ids: dict[str, int] = {}
        self._group_numbers = count()
        for name in tables or []:
            self.table_id(name)

    def table_id(self, name: str) -> int:
        if name not in self._ids:
            if len(self._ids) >= ids.MAX_TABLES:
                raise ValueError("a trail holds at most 65536 tables")
            self._ids[name] = len(self._ids)
        return self._ids[name]

    def table_name(self, table_id: int) -> str:
        return self.names[table_id]

    @property
    def names(self) -> dict[int, str]:
        return {tid: name for name, tid in self._ids.items()}

    def as_table(self, spark) -> DataFrame:
        """The register as a table, to be stored beside edges."""
        rows = [(tid, name) for tid, name in self.names.items()]
        return spark.createDataFrame(rows, "table_id int, table_name string")

    def next_group(self) -> int:
        return next(self._group_numbers)

    def source(
        self,
        df: DataFrame | Tracked,
        name: str,
        row_key: str | None = None,
        order_by: list[str] | None = None,
        nan_columns: list[str] | None = None,
        unique: bool = False,
        verify: bool = False,
        numbered: bool = False,
    ) -> Tracked:
        """Register ``df`` as table ``name`` and attach one id per row.

        ``row_key``: a column of whole numbers in [0, 2^48) that is the row number; other values are errors when read.
        ``unique`` declares that no value of it comes twice, as of a primary key: edges then need no ``distinct``. ``verify`` checks
        range and uniqueness now, with two aggregates, and implies ``unique``. Rows of a repeated key have one id together.
        ``numbered``: ``row_key`` was assigned by ``number_rows``, so no value can repeat; it implies ``unique``.
        ``order_by``: columns that order the table; the row number is the place in that order.
        ``nan_columns``: float columns whose NaN must become NULL (all of them by default).
        A frame that is tracked already is returned unchanged.
        """
        if isinstance(df, Tracked):
            return df
        reserved = [c for c in df.columns if ids.is_hidden(c)]
        if reserved:
            raise ValueError(f"column names starting with {ids.PREFIX} are reserved: {reserved}")
        if (row_key is None) == (order_by is None):
            raise ValueError("give either row_key or order_by")
        floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        chosen = floats if nan_columns is None else floats & set(nan_columns)
        if chosen:
            df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in sorted(chosen)})
        table_id = self.table_id(name)
        column = f"{ids.PREFIX}{table_id}"
        if row_key is not None:
            if verify:
                _check_key(df, row_key)
            df = df.withColumn(column, ids.pack(table_id, ids.checked_row(F.col(row_key), row_key)))
            unique = unique or verify or numbered
        else:
            unique = numbered = True
            df = number_rows(df, order_by)
            df = df.withColumn(column, ids.pack(table_id, F.col("_row"))).drop("_row")
        return Tracked(df, self, exact=unique, numbered=numbered)


def _check_key(df: DataFrame, key: str) -> None:
    n, low, high = df.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    distinct = df.select(key).na.drop().distinct().count()
    if n and (distinct != n or low < 0 or high > ids.MAX_ROW):
        raise ValueError(f"{key} is not a unique row number in [0, 2^48)")
