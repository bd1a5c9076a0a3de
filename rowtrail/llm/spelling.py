"""Spelling variants: groups of words that differ by one inserted, deleted or replaced code point.

Two words one edit apart agree before the edit and behind it. With the shorter word cut in two, the edit lies in one half, so the words share
the other half; a group of words that shares it is cut again inside the half that may differ, until it is small. What is left once
the differing part is one code point wide is bounded by the alphabet. Small groups are dense tiles: padded matrices of code
points, aligned left and aligned right, in which blocks of rows are compared with one another at once. The length of the common
prefix plus that of the common suffix reaching the longer length minus one tells a single edit. Every pair of near words is met in one group only:
that of the half in which their common prefix ends. No group is compared whole unless it is small, and no pair is ever written: a tile
gives one row per word, with its number of near words and the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import SMALL_IDS, Scratch, column

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, NOISE, FACTOR = 7, 2, 31, 10
GROUP = 64
"""Groups of at most so many words are compared as one tile; larger ones are cut in two."""
TILE_BYTES = 4 << 20


def noisy_words(docs: DataFrame, least_length: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """(word) of every run of letters of whole texts, A-Z lower-cased, if ``least_length`` code points or more are left.

    Where ``noise`` divides h, the unsigned crc32 of ``<doc_id>:<run>``, the code point h % length is deleted. NULL texts have no
    runs; a NULL doc_id counts as the empty string.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    lowered = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = docs.select(own.alias("own"), F.explode(runs).alias("run")).select("own", lowered.alias("run"))
    found = found.select("run", F.crc32(F.concat("own", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    return found.select(word.alias("word")).filter(F.length("word") >= least_length)


def _keyed(rows: DataFrame) -> DataFrame:
    """``g`` names the group: class, differing part [a, b), and what the words share before and behind it."""
    behind = F.col("size") - F.col("b")
    return rows.withColumn(
        "g",
        F.xxhash64("size", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - behind + 1, behind)),
    )


def _cut_in_two(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(
        F.struct(F.col("a").alias("a"), middle.alias("b")),
        F.struct(middle.alias("a"), F.col("b").alias("b")),
    )
    cut = rows.withColumn("part", F.explode(parts)).select("word", "n", "size", "part.a", "part.b")
    return _keyed(cut.filter("b > a"))


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words padded with zeros, aligned left and aligned right, and the lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    if len(flat) and flat.max() < 256:
        flat = flat.astype(np.uint8)
    width = int(size.max()) + 1  # one column of zeros, so that a mismatch or the end is always found
    at = np.arange(width)
    left = np.zeros((len(words), width), flat.dtype)
    left[at < size[:, None]] = flat
    right = np.zeros((len(words), width), flat.dtype)
    right[at >= width - size[:, None]] = flat
    return left, right[:, ::-1], size


def _tile(words: list[str], n: np.ndarray, g: np.ndarray, part: np.ndarray):
    """Per word of the tile: its near words, and the largest n among them with the row of the smallest word that has it.

    Rows of a group are neighbours. Step s compares the block of all rows with the block that begins s rows further down, within groups.
    """
    left, right, size = _matrices(words)
    order = np.argsort(np.argsort(np.array(words, object), kind="stable"), kind="stable")
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)

    def offer(row: np.ndarray, other: np.ndarray) -> None:
        old = best[row]
        better = (old < 0) | (n[other] > n[old]) | ((n[other] == n[old]) & (order[other] < order[old]))
        best[row[better]] = other[better]

    same = (g[1:] == g[:-1]) & (part[1:] == part[:-1]).all(1)
    begins = np.flatnonzero(np.append(True, ~same))
    left_over = np.repeat(np.append(begins[1:], len(words)), np.diff(np.append(begins, len(words)))) - np.arange(len(words))
    step = 1
    rows = np.flatnonzero(left_over > step)
    while len(rows):
        for lo in range(0, len(rows), max(1, TILE_BYTES // left.shape[1])):
            i = rows[lo : lo + max(1, TILE_BYTES // left.shape[1])]
            j = i + step
            shorter, longer = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = (shorter == part[i, 0]) & (longer <= part[i, 0] + 1)
            i, j, shorter, longer = i[ok], j[ok], shorter[ok], longer[ok]
            differs = left[i] != left[j]
            differs[:, -1] = True
            prefix = np.minimum(differs.argmax(1), shorter)
            # the other end matters only where the prefix ends in this group's part
            ok = (prefix >= part[i, 1]) & ((prefix < part[i, 2]) | (prefix == shorter) & (part[i, 2] == shorter))
            i, j, prefix, shorter, longer = i[ok], j[ok], prefix[ok], shorter[ok], longer[ok]
            differs = right[i] != right[j]
            differs[:, -1] = True
            suffix = np.minimum(differs.argmax(1), shorter)
            ok = prefix + suffix >= longer - 1
            i, j = i[ok], j[ok]
            count[i] += 1
            count[j] += 1
            offer(i, j)
            offer(j, i)
        step += 1
        rows = rows[left_over[rows] > step]
    return count, best


TILES = "word string, n_near long, best_n long, best string"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, in tiles of whole groups."""
    rest: pa.Table | None = None

    def out(t: pa.Table) -> pa.RecordBatch:
        words, n = t["word"].to_pylist(), t["n"].to_numpy()
        part = np.stack([t[c].to_numpy() for c in ("size", "a", "b")], 1)
        count, best = _tile(words, n, t["g"].to_numpy(), part)
        at = np.flatnonzero(count)
        to = best[at]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in at], pa.string()), pa.array(count[at]), pa.array(n[to]), pa.array([words[i] for i in to], pa.string())],
            ["word", "n_near", "best_n", "best"],
        )

    def cuts(t: pa.Table, last: bool) -> Iterator[pa.Table]:
        """Whole groups of bounded padded size; what may go on in the next batch comes last."""
        g, size = t["g"].to_numpy(), t["size"].to_numpy() + 2
        ends = np.append(np.flatnonzero((g[1:] != g[:-1]) | (size[1:] != size[:-1])) + 1, len(g))
        lo = done = 0
        for end in ends.tolist():
            if end == len(g) and not last:
                break
            if done > lo and (end - lo) * size[lo:end].max() > TILE_BYTES:
                yield t.slice(lo, done - lo)
                lo = done
            done = end
        yield t.slice(lo, done - lo)
        yield t.slice(done)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None and len(rest) else t
        *whole, rest = cuts(t, False) if len(t) else [t]
        for piece in whole:
            if len(piece):
                yield out(piece)
    if rest is not None and len(rest):
        for piece in cuts(rest, True):
            if len(piece):
                yield out(piece)


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``words`` (word, n; words are distinct): (word, n_near, best_n, best) of those that have near words.

    ``best`` is the near word of the largest n, of equal ones the smallest in code-point order. NULL words are left out.
    """
    words = words.filter("word IS NOT NULL AND word <> ''").select("word", F.col("n").cast("long").alias("n"))
    least = words.agg(F.min(F.length("word"))).first()[0]
    length = F.length("word")
    # a word meets words of its own length in the class of that length, and shorter ones in the class below
    classes = F.when(length > least, F.array(length, length - 1)).otherwise(F.array(length))
    todo = words.withColumn("size", F.explode(classes)).select("word", "n", "size", F.lit(0).alias("a"), F.col("size").alias("b"))
    todo = scratch.write(_cut_in_two(todo), "halves")
    ready = None
    while True:
        large = todo.groupBy("g").agg(F.count("*").alias("rows"), F.max(F.col("b") - F.col("a")).alias("wide"))
        large = scratch.write(large.filter(f"rows > {GROUP} AND wide > 1").select("g"), "large")
        n_large = large.count()
        if not n_large:
            ready = todo if ready is None else ready.unionByName(todo)
            break
        marked = F.broadcast(large) if n_large <= SMALL_IDS else large
        small = todo.join(marked, "g", "left_anti").select(*todo.columns)
        ready = small if ready is None else ready.unionByName(small)
        todo = scratch.write(_cut_in_two(todo.join(marked, "g", "left_semi")), "parts")
    tiles = ready.repartition("size", "g").sortWithinPartitions("size", "g", "a", "b").mapInArrow(_tiles, TILES)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("x")
    met = tiles.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return met.select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.w").alias("best"))


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; other columns are ignored).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n
    (ties: the smallest in code-point order) if that n is ``factor`` times its own or more, else NULL; its root is the last word
    that is reached by following forms, itself if it has none. Rows repeating a word are one word with the sum of their n. A NULL or empty
    word is left out. Words of any length are compared whole. No rows give no rows.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
    words = words.filter("word IS NOT NULL AND word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.write(words, "words")
    if words.isEmpty():
        return words.selectExpr("word", "word AS form", "word AS root", "n", "n AS n_near", "n AS form_n")
    met = scratch.write(near_words(words, scratch), "near")
    good = F.col("best_n") >= factor * F.col("n")
    formed = words.join(met, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
    )
    formed = scratch.write(formed, "forms")
    # n grows with every step, so chains are short; each round halves what is left of them
    up = scratch.write(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while not up.isEmpty():
        over = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        jumped = up.join(over, "root", "left").select(
            "word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")
        )
        jumped = scratch.write(jumped, "jumped")
        scratch.drop(up)
        up = jumped
        if jumped.filter("moved").isEmpty():
            break
        up = jumped.drop("moved")
        up._scratch_path = jumped._scratch_path
    roots = up.select("word", "root")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_spellings(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """The spelling variants among the words of ``docs`` (doc_id, text; other columns are ignored) that occur ``least_count`` times or more.

    Rows repeating a doc_id count each; a NULL, empty or wordless text adds nothing; texts are read whole.
    """
    counted = noisy_words(docs, least_length).groupBy("word").agg(F.count("*").alias("n"))
    return spelling_variants(counted.filter(F.col("n") >= least_count))
