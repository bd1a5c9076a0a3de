"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has ``bins`` coordinates. In round i each shingle is hashed to one bin with value i + fraction, and a bin keeps its smallest
value; rounds go on until every bin is filled. After ``bins`` rounds, round ``bins + j`` puts every shingle into bin j, so every
coordinate fills after at most twice ``bins`` rounds, and two sketches agree in each coordinate with the Jaccard similarity of the
sets, concentrated around it as for independent samples. Large sets fill in one or two rounds (Dahlgaard, Knudsen and Thorup 2017).

Documents meet where all coordinates of a band agree. With 32 bands of 5 rows a pair at similarity 0.8 shares a band with probability
1 - (1 - 0.8^5)^32 = 1 - 3e-6. Pairs are confirmed on their full sets. Within a band documents are not paired with each other but
with its smallest and its largest document. Where documents of a band stay in different components, those pairs are looked for that share
a shingle among the rarest of both, and verified unless their whole sketches rule them out. So no link that matters for a component
is lost, and a group is not expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.graph import components
from rowtrail.llm.shared import Scratch, column, long_list, slices, text_buffers, with_ids
from rowtrail.llm.words import U, Words, digests, mix, words_of

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
RULED_OUT = 0.6
"""A pair whose sketches agree in less than this share of coordinates is not verified after the leaders. At similarity 0.8
the share has a standard deviation of 0.032, so this is more than six of them below; it depends on the bands alone, not on the data."""
LIKE_SIZE = "n_shingles * 5 >= lead_n * 4 AND lead_n * 5 >= n_shingles * 4"
"""Sets of less alike sizes cannot reach similarity 0.8."""
FULL = U(2**64 - 1)
SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text; a shorter text is one shingle of all its words; no words, no shingle."""
    runs, bounds = words.runs(k)
    counts = words.counts
    if not ((counts > 0) & (counts < k)).any():
        return runs, bounds
    parts, sizes = [], []
    for i, n in enumerate(counts):
        if 0 < n < k:
            lo = words.bounds[i]
            whole = mix(np.array([int(n)], U))
            for h in words.hashes[lo : lo + n]:
                whole = mix(whole * U(0x9E3779B97F4A7C15) + h)
            parts.append(whole)
        else:
            parts.append(runs[bounds[i] : bounds[i + 1]])
        sizes.append(len(parts[-1]))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def sets_of(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, sorted within the text."""
    parts = [np.unique(hashes[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(parts) if parts else hashes), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def sketches(hashes: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values per text; a text without shingles keeps all bins empty."""
    n = len(bounds) - 1
    out = np.full((n, bins), FULL, U)
    flat = out.reshape(-1)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(n), counts)
    open_ = counts > 0
    for i in range(2 * bins):
        h = mix(hashes ^ SEEDS[i])
        low = h & U((1 << 55) - 1)
        at = (((h >> U(32)) * U(bins)) >> U(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, owner * bins + at, low | U(i << 55))
        still = open_ & (out == FULL).any(axis=1)
        if not still.any():
            break
        if still.sum() < open_.sum():
            stay = still[owner]
            hashes, owner = hashes[stay], owner[stay]
        open_ = still
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS keys per row of the sketch."""
    n = len(sketch)
    cut = sketch.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=U) + U(77)), (n, BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key


def _sketch_batches(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            ids = column(batch, "doc_id")
            for lo, hi in slices(offsets):
                words = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
                sets, bounds = sets_of(*shingles(words, shingle_words))
                sizes = np.diff(bounds)
                first, second = digests(sets, bounds)
                sketch = sketches(sets, bounds)
                keys = band_keys(sketch).view(np.int64)
                filled = sizes > 0
                ends = np.concatenate([[0], np.cumsum(filled * BANDS)])
                small = (mix(sketch) >> U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.array([row.tobytes() for row in small], pa.binary()),
                        long_list(keys[filled].reshape(-1), ends),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "sketch", "bands"],
                )

    return run


SKETCHED = "doc_id long, n_shingles long, k1 long, k2 long, sketch binary, bands array<long>"


def _verify(shingle_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                data, offsets = text_buffers(column(batch, name))
                parts = []
                for lo, hi in slices(offsets):
                    words = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
                    h, bounds = shingles(words, shingle_words)
                    parts += [np.unique(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                sides.append(parts)
            linked = []
            for x, y in zip(*sides, strict=True):
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common) and len(both) > 0)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "a"), column(batch, "b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
            )

    return run


def _sets(shingle_words: int):
    """(rep, shingle): the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            ids = column(batch, "doc_id")
            for lo, hi in slices(offsets):
                words = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
                sets, bounds = sets_of(*shingles(words, shingle_words))
                row = pa.array(np.repeat(np.arange(lo, hi), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([ids.take(row), pa.array(sets.view(np.int64))], ["rep", "shingle"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose sketches agree often enough to be worth the exact check."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(column(batch, n).to_pylist()), np.uint8).reshape(-1, BINS) for n in ("sketch_a", "sketch_b"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= RULED_OUT))


def near_duplicates(docs: DataFrame, shingle_words: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked where 100 * |common shingles| >= ``percent`` * |all shingles|; words are those of ``words.py`` with A-Z
    lower-cased; ``component_id`` is the smallest doc_id reachable over links and ``kept`` tells whether it is the document's own.
    A NULL text and one without words have no shingle and link with nothing. Equal sets are one class from the start, so exact copies
    cost one row each. Rows repeating a doc_id count as one document and share a component. A NULL doc_id stays alone: component NULL,
    kept. No rows give no rows. Bands hold for ``percent`` from 80 on; lower values lose links.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.write(docs.mapInArrow(_sketch_batches(shingle_words), SKETCHED), "sketched")
    full = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.write(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    heads = full.join(classes, ["k1", "k2"]).filter("doc_id = rep").select("rep", "n_shingles", "sketch", "bands")
    heads = scratch.write(heads, "heads")
    bands = heads.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    bands = scratch.write(bands.join(scratch.write(shared, "shared"), "key"), "bands")
    ids = scratch.write(bands.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    texts = scratch.write(with_ids(docs, ids, "doc_id"), "texts")
    check = _Check(texts, scratch, shingle_words, percent)

    # the smallest and the largest document of each band lead it
    leaders = bands.select("rep", F.explode(F.array("lo", "hi")).alias("leader")).filter("rep <> leader")
    check.pairs(leaders.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")))
    now = _labelled(bands.select("key", "rep", "n_shingles"), check.labels)
    check.pairs(_rest(now, check, scratch), joined=_ruled_in(heads))
    labels = check.labels

    out = sketched.join(classes, ["k1", "k2"], "left")
    out = out.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    if labels is not None:
        out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _labelled(bands: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return bands.withColumn("comp", F.col("rep"))
    joined = bands.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.select("key", "rep", "n_shingles", F.coalesce("root", "rep").alias("comp"))


def _rest(now: DataFrame, check: _Check, scratch: Scratch) -> DataFrame:
    """Pairs across components that may still be linked, among the documents of bands whose documents are in several components.

    With all shingles in one order, rarest first, two sets that are similar enough share one of the first ``n - ceil(percent * n) + 1`` of
    either; so documents meet in those alone, and only where enough shingles are left in both sets from the first common one on. A heavily
    edited member of a group has its own, rare shingles first, and too few after them. Members of the largest component of a shingle
    meet only those of other components.
    """
    now = scratch.write(now, "now")
    open_ = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    docs = now.join(scratch.write(open_, "open"), "key").select("rep", "comp", "n_shingles").distinct()
    docs = scratch.write(docs, "docs")
    ids = docs.select(F.col("rep").alias("doc_id")).distinct()
    sets = with_ids(check.texts, ids, "doc_id").mapInArrow(_sets(check.shingle_words), "rep long, shingle long")
    sets = scratch.write(sets.distinct(), "sets")
    common = sets.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    held = sets.join(scratch.write(common, "common"), "shingle").groupBy("rep")
    held = held.agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * check.percent / 100) + 1
    first = (first - (F.col("n_shingles") - F.size("held"))).cast("int")  # shingles of no other document come before all others
    sizes = docs.groupBy("comp").agg(F.count("*").alias("size"))
    meeting = held.join(docs.join(sizes, "comp"), "rep").filter(first > 0)
    # how many shingles of the set are left from this one on
    left = F.size("held") - F.col("pos")
    meeting = meeting.select("rep", "comp", "n_shingles", "size", "held", F.posexplode(F.slice("held", F.lit(1), first)).alias("pos", "at"))
    meeting = meeting.select("rep", "comp", "n_shingles", "size", left.alias("left"), F.col("at.shingle").alias("shingle"))
    meeting = scratch.write(meeting, "meeting")
    most = meeting.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("comp", "size").alias("largest"))
    most = scratch.write(most.filter("lo < hi").select("shingle", "largest"), "most")
    x = meeting.join(most, "shingle").filter("comp <> largest").select(
        "shingle", F.col("rep").alias("a"), F.col("comp").alias("comp_a"), "n_shingles", F.col("left").alias("left_a")
    )
    y = meeting.select(
        "shingle", F.col("rep").alias("b"), F.col("comp").alias("comp_b"), F.col("n_shingles").alias("lead_n"), F.col("left").alias("left_b")
    )
    enough = f"least(left_a, left_b) * {100 + check.percent} >= {check.percent} * (n_shingles + lead_n)"
    pairs = scratch.write(x, "side").join(y, "shingle").filter(f"comp_a <> comp_b AND {LIKE_SIZE} AND {enough}")
    scratch.drop(sets)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _ruled_in(heads: DataFrame):
    """A function that leaves out pairs whose sketches agree too seldom."""

    def keep(pairs: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(heads.select(F.col("rep").alias(c), F.col("sketch").alias(f"sketch_{c}")), c)
        return pairs.mapInArrow(_alike, "a long, b long")

    return keep


class _Check:
    """Verifies pairs on whole texts and keeps the links, the components they make, and the pairs that need no second test."""

    def __init__(self, texts: DataFrame, scratch: Scratch, shingle_words: int, percent: int):
        self.texts, self.scratch, self.shingle_words, self.percent = texts, scratch, shingle_words, percent
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def pairs(self, pairs: DataFrame, joined=lambda pairs: pairs) -> None:
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = joined(self.scratch.write(pairs, "pairs"))
        for c in "ab":
            pairs = pairs.join(self.texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")), c)
        checked = pairs.mapInArrow(_verify(self.shingle_words, self.percent), "a long, b long, linked boolean")
        checked = self.scratch.write(checked, "checked")
        good, done = checked.filter("linked").select("a", "b"), checked.select("a", "b")
        self.tested = done if self.tested is None else self.tested.unionByName(done)
        if not good.isEmpty():
            self.links = good if self.links is None else self.links.unionByName(good)
            self.labels = components(self.links, self.scratch)
