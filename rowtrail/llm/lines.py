"""Line de-duplication over the suffixes of line-ID sequences, by distributed prefix doubling.

Every line is an ID; a document is a sequence of IDs. Level k names, for each position, the run of 2^k lines that starts there: the name
of level k + 1 is made from the names of level k at the position and 2^k lines on, one join per level, as in building a suffix array.
Positions whose name occurs once are settled and leave, so only repeated runs are carried on. Positions with equal names at level k are
one interval of the suffix array with a common prefix of 2^k lines or more; the order of the intervals among each other is never needed and
not computed. A run of any length is named by the two names of the largest power of two that cover it.

A run counts from ``min_chars`` characters on, so from each position the shortest run that long is looked up, and the union of all that occur
before, by (doc_id, line), goes. That is less than the union of all maximal repeated runs: the last lines of a repeated run stay where fewer
than ``min_chars`` characters are left from each of them to its end. The SQL of the query has the same rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import Scratch, cleared, column, slices, text_buffers, widened
from rowtrail.llm.words import BASE, KEEP, U, mix, segment_sum

MIN_CHARS = 20
NAMES = ["n_lines", "n_removed", "kept_sha256"]
ADDED = "n_lines long, n_removed long, kept_sha256 string"
LINES = "doc_id long, k1 long, line int, name long, need int"
PLACE = ["doc_id", "k1", "line"]


def lines_of(data: np.ndarray, offsets: np.ndarray):
    """Hash, start and end of all lines of texts lying one after the other, and n + 1 bounds by text. Every text has a line.

    A line's hash is the sum over its blocks of eight bytes, each mixed with its place, mixed with the length.
    """
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    # after a break, and at the start of each text
    starts = np.concatenate([breaks + 1, offsets[:-1]])
    ends = np.concatenate([offsets[np.searchsorted(offsets, breaks, side="right")], offsets[1:]])
    owner = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(len(offsets) - 1)])
    order = np.lexsort((starts, owner))
    starts, ends, owner = starts[order], ends[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    # a line ends before the next line of its text
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    ends[inner] = starts[inner + 1] - 1
    size = ends - starts
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    blocks = -(-size // 8)
    upto = np.concatenate([[0], np.cumsum(blocks)])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], blocks)
    at = np.repeat(starts, blocks) + 8 * place
    left = np.minimum(np.repeat(ends, blocks) - at, 8)
    values = mix((eight[at] & KEEP[left]) ^ mix(place.astype(U) + U(BASE)))
    return mix(segment_sum(values, upto) + U(BASE) * size.astype(U)), starts, ends, bounds


def text_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each text's whole sequence, to tell rows with one doc_id and different texts apart."""
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    return mix(segment_sum(mix(hashes + place.astype(U) * U(BASE)), bounds)).view(np.int64)


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            for lo, hi in slices(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                h, starts, ends, bounds = lines_of(own, at)
                # characters before each byte: bytes that begin one
                begins = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                chars = np.concatenate([[0], np.cumsum(begins[ends] - begins[starts])])
                counts = np.diff(bounds)
                index = np.arange(len(h))
                need = np.maximum(np.searchsorted(chars, chars[:-1] + min_chars) - index, 1)
                need[index + need > np.repeat(bounds[1:], counts)] = 0
                row = np.repeat(np.arange(lo, hi), counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc_id").take(pa.array(row)), pa.array(np.repeat(text_keys(h, bounds), counts)),
                        pa.array((index - np.repeat(bounds[:-1], counts)).astype(np.int32)), pa.array(h.view(np.int64)),
                        pa.array(need.astype(np.int32)),
                    ],
                    ["doc_id", "k1", "line", "name", "need"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        raw = data.tobytes()
        counts, removed, texts = [], [], []
        for i, spans in enumerate(column(batch, "spans").to_pylist()):
            part = raw[offsets[i] : offsets[i + 1]]
            lines = part.split(b"\n")
            if spans:
                h, _, _, bounds = lines_of(data[offsets[i] : offsets[i + 1]], np.array([0, len(part)]))
                key = text_keys(h, bounds)[0]
                gone = {j for s in spans if s["k1"] == key for j in range(s["line"], s["line"] + s["need"])}
                kept = [x for j, x in enumerate(lines) if j not in gone]
            else:
                kept = lines
            counts.append(len(lines))
            removed.append(len(lines) - len(kept))
            texts.append(b"\n".join(kept).decode())
        yield pa.RecordBatch.from_arrays(
            [
                *(column(batch, c) for c in batch.schema.names if c not in ("text", "spans")),
                pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ],
            [*(c for c in batch.schema.names if c not in ("text", "spans")), "text", "n_lines", "n_removed", "kept_sha256"],
        )


def repeated_runs(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, line, need): runs of ``need`` lines from ``line`` on that occur at a smaller (doc_id, k1, line) too."""
    lines = scratch.write(docs.filter("doc_id IS NOT NULL").mapInArrow(_lines(min_chars), LINES), "lines")
    names = lines
    found: list[DataFrame] = []
    size = 1
    while True:
        twice = names.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
        names = scratch.write(names.join(scratch.write(twice, "twice"), "name").select(*PLACE, "name", "need"), "names")
        # runs of size … 2 * size - 1 lines: by the names of their first and last ``size`` lines
        ends = names.filter(f"need >= {size} AND need < {2 * size}")
        if size > 1:
            last = names.select("doc_id", "k1", F.col("line").alias("end"), F.col("name").alias("last"))
            ends = ends.withColumn("end", (F.col("line") + F.col("need") - size).cast("int")).join(last, ["doc_id", "k1", "end"])
        else:
            ends = ends.withColumn("last", F.lit(0).cast("long"))
        ends = scratch.write(ends.select(*PLACE, "need", "name", "last"), "runs")
        place = F.struct(*PLACE)
        firsts = ends.groupBy("need", "name", "last").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
        firsts = scratch.write(firsts.drop("n"), "firsts")
        found.append(ends.join(firsts, ["need", "name", "last"]).filter(place > F.col("first")).select(*PLACE, "need"))
        if names.filter(f"need >= {2 * size}").isEmpty():
            break
        after = names.select("doc_id", "k1", (F.col("line") - size).cast("int").alias("line"), F.col("name").alias("next"))
        doubled = names.join(after, PLACE).select(*PLACE, F.xxhash64("name", "next").alias("name"), "need")
        names, size = scratch.write(doubled, "doubled"), 2 * size
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def line_duplicates(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns of ``docs`` with what is left of ``text``, and n_lines, n_removed, kept_sha256 (of the text that is left).

    Lines are what ``\\n`` separates, byte for byte. A line is removed where a run of consecutive lines that covers it, the shortest
    from its first line on that has ``min_chars`` characters (line breaks not counted), also starts at a smaller (doc_id, line); so the first
    copy stays, and a run repeated inside one document goes as well. Short last lines of a repeated run stay, see above. A NULL text becomes the empty text, one empty line. A row without doc_id stays whole and
    takes nothing from others. Equal rows are one document and come out equal; rows with one doc_id and different texts are put in an
    order of their own. Columns of ``docs`` named like the added ones are replaced. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = cleared(docs, f"{ADDED}, spans int")
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    spans = repeated_runs(docs.select("doc_id", "text"), scratch, min_chars)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "line", "need")).alias("spans"))
    joined = docs.join(scratch.write(spans, "spans"), "doc_id", "left")
    return joined.mapInArrow(_cut, widened(joined.drop("text", "spans"), f"text string, {ADDED}")).select(*docs.columns, *NAMES)
