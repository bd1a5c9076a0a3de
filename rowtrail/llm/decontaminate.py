"""Benchmark passages in documents, by spaced-seed hashing and verification along diagonals.

Each mask picks six of up to twelve neighbouring words and ignores those between. The words picked are hashed at every position of every
document and of every benchmark item; where the hashes meet, the item is laid over the document at that place and the words are
compared one by one. The four masks together meet in every overlap that counts, wherever its replaced words are: a longer one holds one of
at most 32 words that counts too, and for these, and for items of 12 to 15 words, all places were tried. Items of 8 to 11 words have three
shorter masks of their own, of which the same holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import SLICE_BYTES, Scratch, cleared, column, slices, text_buffers, widened
from rowtrail.llm.words import SEPARATOR, U, Words, mix, words_of

MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6), (0, 3, 4, 6, 7, 8), (0, 1, 3, 8, 9, 11))
SHORT_MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4))
LEAST_WORDS, PER_MISS = 13, 4
"""Equal words of an overlap at least, and for each unequal one at least."""
SHORTEST_ITEM, SHORT_ITEM = 8, 12
BLOCK_BYTES = 4 << 20
"""Benchmark text per pass. Its index takes about twelve times as much in each task; a larger benchmark is met in several passes."""
HITS = "n_words long, hits array<struct<item_id:bigint,first:int,length:int,matched:int>>, kept boolean"
STEPS = mix(np.arange(1, 13, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
FILTER_BITS = 22


def seeds(words: Words, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the masked words at every position where the mask fits into its text, and these positions."""
    span = mask[-1] + 1
    n = len(words.hashes) - span + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    value = np.zeros(n, U)
    for j in mask:
        value += words.hashes[j : j + n] * STEPS[j]
    fits = np.ones(n + span, bool)
    for edge in words.bounds[1:-1]:
        fits[max(edge - span + 1, 0) : edge] = False
    at = np.flatnonzero(fits[:n])
    return mix(value[at]), at


class Index:
    """The seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets, lower=True, blank=SEPARATOR)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.hashes, self.bounds = words.hashes, words.bounds
        self.tables = []
        for mask, least, below in (*((m, SHORT_ITEM, np.inf) for m in MASKS), *((m, SHORTEST_ITEM, SHORT_ITEM) for m in SHORT_MASKS)):
            h, at = seeds(words, mask)
            size = words.counts[np.searchsorted(self.bounds, at, side="right") - 1]
            good = (size >= least) & (size < below)
            if not good.any():
                continue
            h, at = h[good], at[good]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[h >> U(64 - FILTER_BITS)] = True
            self.tables.append((mask, h, at, seen))


def overlaps(words: Words, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item number, first word in the text, length, matching words) of all overlaps that hold."""
    found = []
    for mask, table, places, seen in index.tables:
        h, at = seeds(words, mask)
        may = seen[h >> U(64 - FILTER_BITS)] if len(h) else np.zeros(0, bool)
        h, at = h[may], at[may]
        lo, hi = np.searchsorted(table, h, side="left"), np.searchsorted(table, h, side="right")
        n = hi - lo
        if not n.sum():
            continue
        at = np.repeat(at, n)
        place = places[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        text = np.searchsorted(words.bounds, at, side="right") - 1
        item = np.searchsorted(index.bounds, place, side="right") - 1
        found.append(np.stack([text, item, (at - words.bounds[text]) - (place - index.bounds[item])], axis=1))
    out = []
    for text, item, shift in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
        own = words.hashes[words.bounds[text] : words.bounds[text + 1]]
        other = index.hashes[index.bounds[item] : index.bounds[item + 1]]
        lo, hi = max(shift, 0), min(shift + len(other), len(own))
        same = own[lo:hi] == other[lo - shift : hi - shift]
        need = min(LEAST_WORDS, -(-PER_MISS * len(other) // (PER_MISS + 1)))
        if np.count_nonzero(same) < need:
            continue
        first, length, matched = longest_stretch(same)
        if matched >= need:
            out.append((text, item, lo + first, length, matched))
    return out


def longest_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """First, length and number of matches of the longest stretch with ``PER_MISS`` matches or more per miss, without misses at its ends.

    No other such stretch has more matches: one with m of them can be widened by misses to m + m // PER_MISS words, or to all there are, and
    a stretch as long as that has m matches at least. So if any has enough of them, this one has.
    """
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -PER_MISS))])
    low = np.minimum.accumulate(score)
    # the first place from which on the sum up to each end is not negative
    starts = np.searchsorted(-low, -score, side="left")
    end = int(np.argmax(np.arange(len(score)) - starts))
    start = int(starts[end])
    at = start + np.flatnonzero(same[start:end])
    return (int(at[0]), int(at[-1] - at[0]) + 1, len(at)) if len(at) else (start, 0, 0)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """First, length and number of matches of the densest stretch: that with most matches over ``PER_MISS`` times its misses.

    Not for deciding on a hit: between two misses it may be too short where the whole overlap is long enough.
    """
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -PER_MISS))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.argmin(score[: end + 1]))
    return start, end - start, int(same[start:end].sum())


def _meet(block: Broadcast, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block.value)
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            before = [[]] * batch.num_rows if first else column(batch, "hits").to_pylist()
            counts, hits = [], []
            for lo, hi in slices(offsets, SLICE_BYTES):
                words = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True, blank=SEPARATOR)
                counts.append(words.counts)
                own = [list(x) for x in before[lo:hi]]
                for text, item, start, length, matched in overlaps(words, index):
                    own[text].append({"item_id": int(index.ids[item]), "first": start, "length": length, "matched": matched})
                hits += own
            names = [n for n in batch.schema.names if n not in ("n_words", "hits", "kept")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(batch, n) for n in names),
                    pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                    pa.array(hits, HIT_TYPE), pa.array([not h for h in hits], pa.bool_()),
                ],
                [*names, "n_words", "hits", "kept"],
            )

    return run


HIT_TYPE = pa.list_(
    pa.struct([("item_id", pa.int64()), ("first", pa.int32()), ("length", pa.int32()), ("matched", pa.int32())])
)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``BLOCK_BYTES`` of text; one list is on the driver at a time."""
    rows: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "item_id IS NOT NULL AND text IS NOT NULL"
    ).toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows or not size:
        yield rows


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of ``docs`` and n_words, hits (item_id, first, length, matched), kept (no hit).

    Words are runs of bytes other than ASCII blanks and punctuation, A-Z lower-cased. A hit is a stretch of an item laid over the text
    without shifts in which four in five words are equal, ``LEAST_WORDS`` of them at least (of items shorter than that: four fifths of
    the item). Items of fewer than ``SHORTEST_ITEM`` words are too common to tell anything and never hit. A NULL text has no words and no
    hits; benchmark rows with a NULL id or text are left out; repeated items hit once each. Rows are taken as they are. Columns of ``docs``
    named like the added ones are replaced. No documents give no rows; an empty benchmark gives no hits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "benchmark")
    docs = cleared(docs, HITS)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = widened(docs, HITS)
    first = True
    for items in blocks(benchmark):
        if not first:
            docs = scratch.write(docs, "met")
        docs = docs.mapInArrow(_meet(spark.sparkContext.broadcast(items), first), schema)
        first = False
    return docs
