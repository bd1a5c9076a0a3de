"""Packing of tokenised documents into sequences of fixed capacity, by large-item matching and best fit.

Only lengths decide where a piece goes, so the plan is made on the table of counts by length, which has at most ``capacity`` rows at any
size of the corpus. Pieces above a third of the capacity fit at most twice into a sequence: they are matched greedily, the longest with
the longest that still fits, which uses as few sequences for them as can be. Smaller pieces, longest first, fill the tightest gaps.
Sequences filled alike are one line of the plan with a count. Each piece then finds its place from its number among the pieces of its
length; the numbers are counted per task and offset by a table of one row per length and task, so no task sees more than its share.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowtrail.llm.shared import Scratch, column
from rowtrail.llm.tokens import encoder, vocabulary

SMALL_OFFSETS = 200_000
"""At most so many rows of offsets, counted first, are broadcast (some 20 MB); more are joined by a shuffle of the pieces, which hold no text."""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lines (n, [(length, times), …]): n sequences that hold each length so many times, in this order."""
    left = {k: v for k, v in counts.items() if v}
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    third = capacity // 3
    large = sorted((k for k in left if k > third), reverse=True)
    for length in large:
        for other in [k for k in large if k <= min(length, capacity - length)]:
            if not left[length]:
                break
            if other == length:
                pairs, left[length] = divmod(left[length], 2)
                if pairs:
                    bins.append((pairs, [(length, 2)]))
            elif left[other]:
                pairs = min(left[length], left[other])
                left[length] -= pairs
                left[other] -= pairs
                bins.append((pairs, [(length, 1), (other, 1)]))
        if left[length]:
            bins.append((left[length], [(length, 1)]))
            left[length] = 0
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for n, held in bins:
        gaps[capacity - sum(a * b for a, b in held)].append((n, held))
    for length in sorted((k for k in left if left[k]), reverse=True):
        while left[length]:
            gap = min((g for g, lines in gaps.items() if g >= length and lines), default=None)
            if gap is None:
                gap, n, held = capacity, left[length], []
            else:
                n, held = gaps[gap].pop()
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                gaps[gap - each * length].append((full, [*held, (length, each)]))
                left[length] -= full * each
                n -= full
            if n and left[length]:  # fewer than ``each`` are left
                gaps[gap - left[length] * length].append((1, [*held, (length, left[length])]))
                left[length] = 0
                n -= 1
            if n and held:
                gaps[gap].append((n, held))
    return [line for lines in gaps.values() for line in lines]


def places(lines: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first number of that length, times, first sequence, offset), by length and number."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, held in lines:
        offset = 0
        for length, times in held:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _tokenised(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                ids = ids_of(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), task, seen[hi - lo]))
                    seen[hi - lo] += 1
            names = [c.split()[0] for c in PIECES.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, small_offsets: int = SMALL_OFFSETS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text; others are ignored).

    A document is the ids of its text by the tokenizers library, without special tokens added, then id 0; a NULL or empty text is id 0
    alone. Documents over ``capacity`` are cut into pieces of that length, of which the first may be shorter. ``ids_crc32`` is over the ids
    as little-endian unsigned 32-bit numbers. Pieces lie in their sequences without gaps from offset 0. Rows are taken as they are: equal
    rows and a NULL doc_id are packed like others. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    path = vocabulary(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.write(rows.mapInArrow(_tokenised(path, capacity), PIECES), "pieces")
    counts = scratch.write(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    # at most ``capacity`` rows
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(by_length, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Spark would judge the offsets by their file, which is coded and tiny
    offsets = F.broadcast(offsets) if counts.count() <= small_offsets else offsets.hint("merge")
    numbered = pieces.join(offsets, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = where[:, 0] << 45 | where[:, 1]
        for batch in batches:
            length, number = (column(batch, c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, length << 45 | number, side="right") - 1
            row = where[at]
            nth = number - row[:, 1]
            kept = [column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
