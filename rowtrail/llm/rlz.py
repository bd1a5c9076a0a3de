"""Substring de-duplication by anchor blocks and hashes of runs, in the place of relative Lempel-Ziv factoring.

No factor is found by extending a match greedily along a reference: that takes a document's whole parse in order, against references that
must all be at hand. Here whole blocks are compared by their hashes, in joins, and runs of words one by one where versions differ.

Every run of ``WINDOW`` words has an anchor: the smallest hash among its ``GRAM``-word grams, which depends on the run's words alone.
Neighbouring runs with the same anchor make up one block of words. Blocks are the references: the index tells, for each
block, the smallest document that has it.

1. Anchors of all documents are counted; only those in two documents or more go on, and only documents that have one are read again.
2. Documents are parsed into blocks around their shared anchors. A block that a smaller document has too is a factor, at least ``WINDOW``
   words long, and a duplicate span as a whole.
3. A run of words may repeat although its block doesn't, where a factor ends. So blocks of an anchor that come in several versions are
   checked at these boundaries run by run: each version's runs, from its first document, against all other versions'.

The outcome is exact (up to equal 64-bit hashes of different runs): every run of ``WINDOW`` words that starts in a smaller document is
found, whichever document that is. Copies of a block cost one row, whatever their number, and no two documents are paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import Scratch, column, long_list, slices, text_buffers, with_ids
from rowtrail.llm.words import BASE, INVERSE, U, Words, mix, powers, sliding, words_of

WINDOW, GRAM = 50, 8


def anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of ``window`` words: its text, its first word (counted over all texts) and its smallest gram hash."""
    grams, bounds = words.runs(gram)
    width = window - gram + 1
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    least = sliding(grams, width)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, words.bounds[text] + within, least[bounds[text] + within]


def sequence_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole word sequence."""
    out = []
    for salt in (0, 0x5BF03635ED2C8A11):
        sums = np.zeros(len(words.hashes) + 1, U)
        np.cumsum(mix(words.hashes ^ U(salt)) * powers(BASE, len(words.hashes)), out=sums[1:])
        at = words.bounds
        out.append(mix((sums[at[1:]] - sums[at[:-1]]) * powers(INVERSE, len(sums))[at[:-1]] + words.counts.astype(U)))
    return out[0], out[1]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        ids = column(batch, "doc_id")
        for lo, hi in slices(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            words = words_of(part, at)
            k1, k2 = sequence_keys(words)
            text, _, least = anchors(words)
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
            text, least = text[new], least[new]
            raw = part.tobytes()
            shas = [hashlib.sha256(b" ".join(raw[x:y].split())).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo), pa.array(words.counts.astype(np.int64)), pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)), pa.array(shas),
                    long_list(least.view(np.int64), np.searchsorted(text, np.arange(hi - lo + 1))),
                ],
                ["doc_id", "n_words", "k1", "k2", "sha", "anchors"],
            )


FIRST = "doc_id long, n_words long, k1 long, k2 long, sha string, anchors array<long>"


def _chosen(batch: pa.RecordBatch, lists: str):
    """Slices of a batch: words, the rows' lists, and which rows hold the text that their ``k1`` names."""
    data, offsets = text_buffers(column(batch, "text"))
    keys = column(batch, "k1").to_numpy(zero_copy_only=False).view(np.uint64)
    values = column(batch, lists)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        words = words_of(part, at)
        good = sequence_keys(words)[0] == keys[lo:hi]
        yield lo, hi, part, at, words, values.slice(lo, hi - lo), good


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks around the shared anchors of each text: anchor, hash of the block, first run and number of runs."""
    for batch in batches:
        ids, keys = column(batch, "doc_id"), column(batch, "k1")
        for lo, hi, _, _, words, shared, good in _chosen(batch, "shared"):
            text, start, least = anchors(words)
            if not len(text):
                continue
            cut = np.ones(len(text), bool)
            cut[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
            first = np.flatnonzero(cut)
            size = np.diff(np.append(first, len(text)))
            flat = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts = shared.value_lengths().to_numpy(zero_copy_only=False)
            wanted = np.zeros(len(first), bool)
            by_text = np.searchsorted(text[first], np.arange(hi - lo + 1))
            done = 0
            for i, n in enumerate(counts):
                x, y = by_text[i], by_text[i + 1]
                if good[i] and n and y > x:
                    wanted[x:y] = np.isin(least[first[x:y]], flat[done : done + n])
                done += n
            first, size = first[wanted], size[wanted]
            if not len(first):
                continue
            sums = np.zeros(len(words.hashes) + 1, U)
            np.cumsum(words.hashes * powers(BASE, len(words.hashes)), out=sums[1:])
            begin = start[first]
            block = mix((sums[begin + size + WINDOW - 1] - sums[begin]) * powers(INVERSE, len(sums))[begin] + size.astype(U))
            row = pa.array(text[first] + lo)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(row), keys.take(row), pa.array(least[first].view(np.int64)), pa.array(block.view(np.int64)),
                    pa.array((begin - words.bounds[text[first]]).astype(np.int32)), pa.array(size.astype(np.int32)),
                ],
                ["doc_id", "k1", "anchor", "block", "first", "runs"],
            )


BLOCKS = "doc_id long, k1 long, anchor long, block long, first int, runs int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and place of every run in the listed blocks."""
    for batch in batches:
        ids, keys = column(batch, "doc_id"), column(batch, "k1")
        for lo, _, _, _, words, spans, good in _chosen(batch, "spans"):
            hashes, bounds = words.runs(WINDOW)
            rows, places, found = [], [], []
            for i, (own, ok) in enumerate(zip(spans.to_pylist(), good, strict=True)):
                if ok:
                    at = np.unique(np.concatenate([np.arange(x["first"], x["first"] + x["runs"]) for x in own]))
                    rows.append(np.full(len(at), lo + i))
                    places.append(at)
                    found.append(hashes[bounds[i] + at])
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(row), keys.take(row), pa.array(np.concatenate(found).view(np.int64)),
                        pa.array(np.concatenate(places).astype(np.int32)),
                    ],
                    ["doc_id", "k1", "run", "first"],
                )


RUNS = "doc_id long, k1 long, run long, first int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletes the spans of each text: number of deleted words, and the text that is left."""
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        raw = data.tobytes()
        keep, removed, texts, rows = [], [], [], []
        for i, (spans, k1) in enumerate(zip(column(batch, "spans").to_pylist(), column(batch, "k1").to_pylist(), strict=True)):
            part = raw[offsets[i] : offsets[i + 1]]
            words = words_of(data[offsets[i] : offsets[i + 1]], np.array([0, len(part)]))
            if sequence_keys(words)[0].view(np.int64)[0] != k1:
                continue
            edges = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edges, [x["first"] for x in spans], 1)
            np.add.at(edges, [min(x["first"] + x["runs"] + WINDOW - 1, len(words.hashes)) for x in spans], -1)
            stay = np.cumsum(edges[:-1]) == 0
            left = b" ".join(w for w, ok in zip(part.split(), stay.tolist(), strict=True) if ok)
            rows.append(i)
            keep.append(int(stay.sum()))
            removed.append(len(stay) - keep[-1])
            texts.append(left.decode())
        row = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id").take(row), column(batch, "k1").take(row), pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.string()),
            ],
            ["doc_id", "k1", "cut", "cut_sha", "kept_text"],
        )


CUT = "doc_id long, k1 long, cut long, cut_sha string, kept_text string"


def substring_duplicates(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text; other columns are ignored).

    A word is removed where a run of ``WINDOW`` consecutive words that covers it also starts in a document with a smaller doc_id; the
    input decides, not what is left. Words are runs of bytes other than ASCII blanks, unchanged; kept words are joined by one space.
    ``with_text`` adds ``kept_text``: the text that is left where words were removed, else NULL (the text stays as it is).
    A NULL text is empty. A row without doc_id neither loses words nor takes any. Rows repeating a doc_id are one document: they do not
    remove each other's words, and equal rows have equal results. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = scratch.write(docs.mapInArrow(_first_pass, FIRST), "base")
    known = base.filter("doc_id IS NOT NULL")
    classes = scratch.write(known.groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = known.filter(F.size("anchors") > 0).join(classes, ["k1", "k2", "n_words"]).filter("doc_id = rep")
    held = firsts.select("doc_id", "k1", F.explode("anchors").alias("anchor"))
    held = scratch.write(held, "held")
    shared = held.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    shared = scratch.write(shared, "shared")
    wanted = held.join(shared, "anchor").groupBy("doc_id", "k1").agg(F.collect_set("anchor").alias("shared"))
    wanted = scratch.write(wanted, "wanted")
    scratch.drop(held, shared)

    ids = scratch.write(wanted.select("doc_id").distinct(), "ids")
    texts = scratch.write(with_ids(docs, ids, "doc_id").join(wanted, "doc_id"), "texts")
    scratch.drop(wanted, ids)
    blocks = scratch.write(texts.mapInArrow(_blocks, BLOCKS), "blocks")
    texts = texts.select("doc_id", "k1", "text")
    versions = scratch.write(blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("rep")), "versions")
    factors = blocks.join(versions, ["anchor", "block"]).filter("doc_id > rep").select("doc_id", "k1", "first", "runs")

    several = scratch.write(versions.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "several")
    edges = versions.join(several, "anchor").join(blocks, ["anchor", "block"]).filter("doc_id = rep")
    edges = edges.groupBy("doc_id", "k1").agg(F.collect_set(F.struct("first", "runs")).alias("spans"))
    runs = scratch.write(texts.join(edges, ["doc_id", "k1"]).mapInArrow(_runs, RUNS), "runs")
    index = runs.groupBy("run").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last")
    index = scratch.write(index.select("run", "rep"), "index")
    single = runs.join(index, "run").filter("doc_id > rep").select("doc_id", "k1", "first", F.lit(1).alias("runs"))

    spans = factors.unionByName(single).groupBy("doc_id", "k1").agg(F.collect_list(F.struct("first", "runs")).alias("spans"))
    cut = texts.join(spans, ["doc_id", "k1"]).mapInArrow(_cut, CUT)
    columns = ["doc_id", "k1", "cut", "cut_sha"] + ["kept_text"] * with_text
    cut = scratch.write(cut.select(*columns).distinct(), "cut")

    out = base.drop("anchors").join(classes, ["k1", "k2", "n_words"], "left").join(cut, ["doc_id", "k1"], "left")
    copy = F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= WINDOW)
    picked = [
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        picked.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*picked)
