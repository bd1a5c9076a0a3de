"""Repeated substrings of bytes by run-length indexes over groups of texts that may have a long match.

A window is ``WINDOW`` bytes of one text. Its anchor is the ``GRAM``-byte gram with the smallest hash, the leftmost of equals, so equal windows have equal
anchors at equal places. Neighbouring windows with the same anchor hash are one block of bytes. Only blocks whose anchor hash occurs again can hold a
repeated window; blocks that repeat whole need no more than a count. What is left are anchors with several versions of their block:

* The versions of an anchor, whole, become part of a collection of about ``COLLECTION`` bytes, for which a task builds a Burrows-Wheeler transform from a
  suffix array (prefix tripling) and keeps what a run-compressed index keeps: at both ends of each run of equal letters the text place and the
  length of the match with the suffix next to it.
* Matching statistics are streamed from these samples in text order: inside a run, a step to the right in the text shortens the match
  by one, so the place before gives the value unless the place is a sample itself. The longest match of a place, over the suffixes above and below, reaching
  ``WINDOW`` marks a repeated window.
* Anchors with more than ``VERSIONS`` versions (a passage that very many texts share, in ever new surroundings) do not go through one collection: the
  windows of their blocks are told apart by hashes, which are counted.

Collections are bounded, whatever the number of copies; no two texts are compared with one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import Scratch, column, long_list, slices, text_buffers, with_ids
from rowtrail.llm.words import BASE, INVERSE, U, mix, powers, sliding

WINDOW, GRAM = 200, 48
WIDTH = WINDOW - GRAM + 1
LONGEST_BLOCK = 512
"""Windows of one block at most; only texts that repeat the same few bytes have so long ones."""
COLLECTION, VERSIONS = 1 << 20, 1024
PART = 4 << 20
"""Longer texts are read in parts of so many bytes, which overlap by a window."""
LETTER = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
PLACE = U((1 << 24) - 1)


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(LETTER[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def _hash(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[first]) * powers(INVERSE, len(sums))[first] + (end - first).astype(U))


def blocks_of(data: np.ndarray, offsets: np.ndarray):
    """The blocks of texts that lie one after the other in ``data``: text, first window (place in ``data``), number of windows, anchor and
    block hash, and whether a window may repeat inside the block."""
    none = np.zeros(0, np.int64)
    counts = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    if not counts.sum():
        return none, none, none, none.view(U), none.view(U), none.astype(bool)
    sums = _sums(data)
    n = len(data) - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(INVERSE, n))
    least = sliding((grams & ~PLACE) | np.arange(n, dtype=U), WIDTH)
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(text)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    place = (least[start] & PLACE).astype(np.int64)
    anchor = grams[place]
    cut = np.ones(len(text), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(text)))
    if size.max() > LONGEST_BLOCK:
        pieces = -(-size // LONGEST_BLOCK)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(np.repeat(size, pieces) - nth * LONGEST_BLOCK, LONGEST_BLOCK)
        first = np.repeat(first, pieces) + nth * LONGEST_BLOCK
    ties = place[first + size - 1] != place[first]
    begin = start[first]
    return text[first], begin, size, anchor[first], _hash(sums, begin, begin + size + WINDOW - 1), ties


def _parts(data: np.ndarray, offsets: np.ndarray):
    """Slices of texts; of a text longer than ``PART`` its parts. Gives first and last text, bytes, offsets and the bytes of the text before."""
    for lo, hi in slices(offsets):
        size = int(offsets[hi] - offsets[lo])
        for at in range(0, max(size - WINDOW + 1, 1), PART):
            end = min(size, at + PART + WINDOW - 1) if hi - lo == 1 else size
            some = data[offsets[lo] + at : offsets[lo] + end]
            yield lo, hi, some, (np.array([0, len(some)]) if hi - lo == 1 else offsets[lo : hi + 1] - offsets[lo]), at
            if hi - lo > 1:
                break


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        ids = column(batch, "doc_id")
        raw = memoryview(data)
        done: list[list] = []

        def out(lo: int, hi: int, done=done, ids=ids, raw=raw, offsets=offsets) -> pa.RecordBatch:
            text, first, size, anchor, block = (np.concatenate(x) for x in zip(*done, strict=True))
            bounds = np.searchsorted(text, np.arange(lo, hi + 1))
            shas = [hashlib.sha256(raw[offsets[i] : offsets[i + 1]]).hexdigest() for i in range(lo, hi)]
            lists = [long_list(x.view(np.int64), bounds) for x in (anchor, block, first, size)]
            return pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(shas), *lists],
                ["doc_id", "n_bytes", "sha", "anchors", "blocks", "firsts", "sizes"],
            )

        now = None
        for lo, hi, some, at, before in _parts(data, offsets):
            if now is not None and now != (lo, hi):
                yield out(*now)
                done.clear()
            now = lo, hi
            text, begin, size, anchor, block, ties = blocks_of(some, at)
            # the sign tells that windows may repeat inside
            done.append([text + lo, begin - at[text] + before, np.where(ties, -size, size), anchor, block])
        if now is not None:
            yield out(*now)


FIRST = "doc_id long, n_bytes long, sha string, anchors array<long>, blocks array<long>, firsts array<long>, sizes array<long>"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed blocks of each text."""
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        raw = memoryview(data)
        for i, spans in enumerate(column(batch, "spans").to_pylist()):
            for lo in range(0, len(spans), 4096):
                some = spans[lo : lo + 4096]
                cut = [bytes(raw[offsets[i] + s["first"] : offsets[i] + s["first"] + s["size"] + WINDOW - 1]) for s in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["anchor"] for s in some], pa.int64()), pa.array([s["block"] for s in some], pa.int64()), pa.array(cut, pa.binary())],
                    ["anchor", "block", "bytes"],
                )


EXTRACTED = "anchor long, block long, bytes binary"


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """Suffixes of ``letters`` (below 511, fewer than 2^21 of them) in order, by prefix tripling from seven letters on."""
    n = len(letters)
    x = np.zeros(n + 8, U)  # behind the end comes what is smaller than every letter
    x[:n] = letters + np.uint16(1)
    two = x << U(9)
    two[:-1] |= x[1:]
    four = two << U(18)
    four[:-2] |= two[2:]
    key = (four[:n] << U(27)) | (four[4 : n + 4] >> U(9))
    order = np.argsort(key)
    rank = np.zeros(n + 1, U)  # the empty suffix comes first
    new = np.ones(n, bool)
    s = key[order]
    new[1:] = s[1:] != s[:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    alone = new & np.append(new[1:], True)
    active, h = np.flatnonzero(~alone), 7
    while len(active):
        place = order[active]
        key = (rank[place] << U(42)) | (rank[np.minimum(place + h, n)] << U(21)) | rank[np.minimum(place + 2 * h, n)]
        by = np.argsort(key)
        place, key = place[by], key[by]
        order[active] = place
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        rank[place] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))] + 1
        active = active[~(new & np.append(new[1:], True))]
        h *= 3
    return order


def _common(letters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``i`` and ``j``."""
    n = len(letters)
    padded = np.zeros(n + 8, np.uint16)
    padded[:n] = letters
    four = np.ndarray((n + 5,), "<u8", padded, strides=(2,))  # four letters at a time
    out = np.zeros(len(i), np.int64)
    open_ = np.arange(len(i))
    while len(open_):
        a, b = i[open_] + out[open_], j[open_] + out[open_]
        ok = np.maximum(a, b) < n
        x = np.where(ok, four[np.minimum(a, n)] ^ four[np.minimum(b, n)], U(1))
        out[open_[x == 0]] += 4
        more = x != 0
        low = x[more]
        out[open_[more]] += (low & U(0xFFFF) == 0).astype(np.int64) + (low & U(0xFFFFFFFF) == 0) + (low & U(0xFFFFFFFFFFFF) == 0)
        open_ = open_[~more]
    return np.minimum(out, n - np.maximum(i, j))


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform: where its runs end, and for both ends of each run the text place and the match beside it."""

    def __init__(self, letters: np.ndarray):
        order = suffix_array(letters)
        bwt = np.where(order > 0, letters[order - 1], 511)  # nothing comes before the first place: a run of its own
        changes = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.n = len(letters)
        self.runs = len(changes) + 1
        self.heads, self.above = self._sampled(letters, order, changes, -1)
        self.tails, self.below = self._sampled(letters, order, changes - 1, 1)

    def _sampled(self, letters, order, rows, beside):
        """Text places, ascending, of run ends with a suffix beside them on the other side of the end, and their matches."""
        place, other = order[rows], order[rows + beside]
        edge = order[0 if beside < 0 else -1]  # has no suffix beside it: its match is empty, and it must be a sample
        length = np.append(_common(letters, place, other), 0)
        place = np.append(place, edge)
        by = np.argsort(place, kind="stable")
        return place[by], length[by]

    def matching_statistics(self) -> np.ndarray:
        """For every place the length of the longest match that starts at another place too, streamed from the samples in text order."""
        at = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for place, length in ((self.heads, self.above), (self.tails, self.below)):
            last = np.zeros(self.n, np.int64)
            last[place[1:]] = 1
            last = np.cumsum(last)
            best = np.maximum(best, length[last] + place[last] - at)
        return best


def repeated_windows(blocks: list[bytes]) -> np.ndarray:
    """Places, counted over all blocks with one letter behind each, whose window starts elsewhere in the collection too."""
    data = np.frombuffer(b"\0".join(blocks) + b"\0", np.uint8)
    size = np.fromiter(map(len, blocks), np.int64, len(blocks)) + 1
    ends = np.cumsum(size)
    letters = data.astype(np.uint16) + np.uint16(1)
    letters[ends - 1] = 0
    match = RunIndex(letters).matching_statistics()
    inside = np.repeat(ends - 1, size) - np.arange(len(data)) >= WINDOW
    return np.flatnonzero((match >= WINDOW) & inside)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by anchor and block: the repeated windows of each, found in collections of whole anchors."""
    held: list[tuple[int, int, bytes]] = []
    size = complete = complete_size = 0

    def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        place = repeated_windows(texts)
        lengths = np.array([len(t) + 1 for t in texts])
        begins = np.cumsum(lengths) - lengths
        row = np.searchsorted(begins, place, side="right") - 1
        cut = np.ones(len(place), bool)
        cut[1:] = (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])
        first = np.flatnonzero(cut)
        n = np.diff(np.append(first, len(place)))
        of = row[first]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in of], pa.int64()), pa.array([rows[i][1] for i in of], pa.int64()),
                pa.array(place[first] - begins[of]), pa.array(n.astype(np.int64)),
            ],
            ["anchor", "block", "at", "windows"],
        )

    for batch in batches:
        for anchor, block, text in zip(*(column(batch, c).to_pylist() for c in ("anchor", "block", "bytes")), strict=True):
            if held and (anchor, block) == held[-1][:2]:
                continue  # a row of the documents that was given twice
            if held and anchor != held[-1][0]:
                if size >= COLLECTION and complete:
                    yield out(held[:complete])
                    held, size = held[complete:], size - complete_size
                complete, complete_size = len(held), size
            held.append((anchor, block, text))
            size += len(text) + 1
    if size >= COLLECTION and complete:
        yield out(held[:complete])
        held = held[complete:]
    if held:
        yield out(held)


INDEXED = "anchor long, block long, at long, windows long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of every window of the blocks."""
    for batch in batches:
        anchors, blocks = column(batch, "anchor"), column(batch, "block")
        for i, text in enumerate(column(batch, "bytes").to_pylist()):
            n = len(text) - WINDOW + 1
            first = np.arange(n)
            found = _hash(_sums(np.frombuffer(text, np.uint8)), first, first + WINDOW)
            row = pa.array(np.full(n, i))
            yield pa.RecordBatch.from_arrays(
                [anchors.take(row), blocks.take(row), pa.array(first), pa.array(found.view(np.int64))], ["anchor", "block", "at", "h"]
            )


WINDOWS = "anchor long, block long, at long, h long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the bytes that the listed windows cover."""
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        removed, runs, shas = [], [], []
        for i, spans in enumerate(column(batch, "spans").to_pylist()):
            part = data[offsets[i] : offsets[i + 1]]
            first = np.array([s["first"] for s in spans], np.int64)
            end = first + np.array([s["size"] for s in spans], np.int64) + WINDOW - 1
            by = np.argsort(first, kind="stable")
            first, end = first[by], np.maximum.accumulate(end[by])
            new = np.append(True, first[1:] > end[:-1])
            first, end = first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
            kept = hashlib.sha256()
            for a, b in zip(np.append(0, end).tolist(), np.append(first, len(part)).tolist(), strict=True):
                kept.update(part[a:b])
            removed.append(int((end - first).sum()))
            runs.append(len(first))
            shas.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [column(batch, "sha"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())],
            ["sha", "n_removed", "n_spans", "cut_sha"],
        )


CUT = "sha string, n_removed long, n_spans long, cut_sha string"


def repeated_substrings(docs: DataFrame, versions: int = VERSIONS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text; other columns are ignored).

    A byte is removed where ``WINDOW`` consecutive bytes of the text that cover it also start anywhere else, in the same row or another; the input
    decides, not what is left. ``n_spans`` counts the maximal removed runs. A NULL text is empty. Every row is a text of its own,
    whether its doc_id is NULL or repeats; rows with equal texts of ``WINDOW`` bytes or more lose all. Texts of any length are taken whole,
    in overlapping parts. Texts, blocks and windows are told apart by hashes: 256, 64 and 64 bits. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "repeated")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = scratch.write(docs.mapInArrow(_first_pass, FIRST).withColumn("row", F.monotonically_increasing_id()), "base")
    classes = base.groupBy("sha").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.min("doc_id").alias("rep"))
    classes = scratch.write(classes, "classes")

    # blocks of one row of each text, where the anchor occurs again
    copies = base.select("sha", "row").join(classes.filter("copies > 1").select("sha", F.col("row").alias("kept")), "sha")
    copies = scratch.write(copies.filter("row <> kept").select("row"), "copies")
    held = with_ids(base.filter(F.size("anchors") > 0).select("row", "anchors", "blocks", "firsts", "sizes"), copies, "row", "left_anti")
    anchors = held.select(F.explode(F.arrays_zip("anchors", "sizes")).alias("z")).select("z.anchors", "z.sizes")
    shared = anchors.groupBy(F.col("anchors").alias("anchor")).agg(F.count("*").alias("n"), F.min("sizes").alias("least"))
    shared = scratch.write(shared.filter("n > 1 OR least < 0").select("anchor"), "shared")
    blocks = held.select("row", F.explode(F.arrays_zip("anchors", "blocks", "firsts", "sizes")).alias("z")).select(
        "row", F.col("z.anchors").alias("anchor"), F.col("z.blocks").alias("block"), F.col("z.firsts").cast("int").alias("first"),
        F.abs("z.sizes").cast("int").alias("size"), (F.col("z.sizes") < 0).alias("ties"),
    )
    blocks = scratch.write(blocks.join(shared, "anchor", "left_semi"), "blocks")
    scratch.drop(shared)

    # versions of each anchor's block: a text is needed where one occurs once and there are others, or where it may repeat in itself
    kinds = blocks.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.max("ties").alias("ties"))
    kinds = scratch.write(kinds, "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.max("ties").alias("ties"))
    several = several.filter("ties OR kinds > 1 AND least = 1").select("anchor", "kinds")
    wanted = kinds.drop("ties").join(several, "anchor").join(blocks.select("anchor", "block", "row", "first", "size"), ["anchor", "block", "row"])
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "block", "first", "size")).alias("spans"))
    wanted = wanted.join(classes.select("row", "sha", "rep"), "row").select("sha", F.col("rep").alias("doc_id"), "spans")
    keyed = docs.withColumn("sha", F.sha2("text", 256))
    same = (F.col("d.sha") == F.col("w.sha")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = keyed.filter(F.length("text") > 0).alias("d").join(wanted.alias("w"), same).select("d.text", "w.spans")
    texts = scratch.write(texts.mapInArrow(_extracted, EXTRACTED), "texts")

    crowded = scratch.write(several.filter(F.col("kinds") > versions).select("anchor"), "crowded")
    small = texts.join(crowded, "anchor", "left_anti")
    found = small.repartition("anchor").sortWithinPartitions("anchor", "block").mapInArrow(_indexed, INDEXED)
    if not crowded.isEmpty():
        windows = texts.join(crowded, "anchor", "left_semi").mapInArrow(_windows, WINDOWS)
        windows = scratch.write(windows, "windows")
        place = F.xxhash64("block", "at")
        again = windows.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select("h")
        found = found.unionByName(
            windows.join(again, "h", "left_semi").select("anchor", "block", "at", F.lit(1).cast("long").alias("windows")).distinct()
        )
    found = found.groupBy("anchor", "block").agg(F.collect_list(F.struct("at", "windows")).alias("found"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("windows")))
    marks = kinds.filter("n > 1").select("anchor", "block", whole.alias("found")).unionByName(
        found.join(kinds.filter("n = 1").select("anchor", "block"), ["anchor", "block"])
    )
    marks = scratch.write(marks, "marks")

    single = classes.filter("copies = 1").select("row", "sha")
    spans = blocks.join(marks, ["anchor", "block"]).join(single, "row").select("sha", "first", "size", F.explode("found").alias("f"))
    windows = F.when(F.col("f.windows") < 0, F.col("size")).otherwise(F.col("f.windows")).cast("int")
    spans = spans.select("sha", F.struct((F.col("first") + F.col("f.at")).cast("int").alias("first"), windows.alias("size")).alias("span"))
    spans = spans.groupBy("sha").agg(F.collect_list("span").alias("spans"))
    cut = scratch.write(keyed.filter(F.length("text") > 0).select("sha", "text").join(spans, "sha").mapInArrow(_cut, CUT), "cut")

    rows = base.select("doc_id", "n_bytes", "sha").join(classes.select("sha", "copies"), "sha").join(cut, "sha", "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    return rows.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
