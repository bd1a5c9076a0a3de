"""Row ids: 16 bits of table number above 48 bits of row number, in one BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW_BITS = 48
MAX_TABLES = 1 << 16
MAX_ROW = (1 << ROW_BITS) - 1

PREFIX = "_prov"
GROUP_PREFIX = "_provg"


def is_hidden(name: str) -> bool:
    """True for the columns that carry lineage instead of data."""
    return name.startswith(PREFIX)


def table_number(column: str) -> int:
    """The table of a hidden id column, from its name."""
    return int(column.removeprefix(PREFIX).split("__")[0])


def pack(table_id: int, row: Column) -> Column:
    if not 0 <= table_id < MAX_TABLES:
        raise ValueError(f"table id {table_id} does not fit in 16 bits")
    return F.shiftleft(F.lit(table_id).cast("long"), ROW_BITS).bitwiseOR(row.cast("long"))


def checked_row(row: Column, name: str) -> Column:
    """A row number given by the user: NULL, negative and too large ones are errors when the row is read, not other rows' ids."""
    row = row.cast("long")
    wrong = F.raise_error(F.concat(F.lit(f"{name} is no row number in [0, 2^48): "), F.coalesce(row.cast("string"), F.lit("NULL"))))
    return F.when(row.between(0, MAX_ROW), row).otherwise(wrong.cast("long"))


def table_of(packed: Column) -> Column:
    # unsigned shift: table numbers from 32768 on set the sign bit
    return F.shiftrightunsigned(packed, ROW_BITS).cast("int")


def row_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(MAX_ROW))


def token(packed: Column, names: dict[int, str]) -> Column:
    """``table:row`` of a packed id."""
    return F.concat_ws(":", table_name(table_of(packed), names), row_of(packed).cast("string"))


def table_name(table_id: Column, names: dict[int, str]) -> Column:
    if not names:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for tid, name in sorted(names.items()) for x in (tid, name)]
    return F.create_map(*pairs)[table_id]
