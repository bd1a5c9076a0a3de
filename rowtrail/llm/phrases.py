"""Phrase collocations from word suffixes, partitioned vertically by their first words.

The suffix at a word is that word and the up to four after it in its piece of text: a suffix tree cut at a depth of five words has the counts of
all phrases as leaf totals. The tree is never whole in one place. It is partitioned by prefixes that fit a memory budget: a prefix that occurs more than
``BUDGET`` times is extended by a word, and its extensions are counted over all texts in their turn; there are few of them, no more than words over
``BUDGET``. Prefixes are dealt to groups of about ``BUDGET`` suffixes each.

1. Words are counted; words below the least count end a suffix, since no phrase with them can count.
2. While there are prefixes beyond the budget, their extensions are counted: those whose last words are beyond it too, as others cannot be.
3. Every task sorts the suffixes of its texts, adds equal ones up and sends them, packed in blocks, to the groups of their prefixes.
4. Each group builds its subtrees by itself: its sorted suffixes, in which a node of depth d is a run of equal first d words. Nodes above a
   prefix are spread over groups; these are the ones counted before.
5. Parts of candidates are looked up in the table of counts, scores are whole-number quotients of decimals.

Words are told apart by 64-bit hashes of language and word. The table of words that reach the least count is sent to all tasks if it
has at most ``SMALL_WORDS`` rows; beyond that suffixes carry the hashes themselves and are not shortened, with the same results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtrail.llm.shared import Scratch, column, slices, text_buffers
from rowtrail.llm.words import U, mix, words_of

DEPTH, LEAST, TOP = 5, 100, 2000
BUDGET = 1 << 19
"""Suffixes that a group holds, about; a task sorts as many of its own at a time."""
SMALL_WORDS = 4_000_000
BLOCK, SALTS, TEXT_BYTES = 1024, 64, 4 << 20
BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
BLANK = BREAK.copy()
BLANK[[9, 32]] = True


def _texts(batches: Iterator[pa.RecordBatch]):
    """Slices of the batches: bytes, words, each word's text row, hash with its language, and whether the next word is in another piece."""
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        langs = column(batch, "lang").dictionary_encode()
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], U)
        lang = langs.indices.to_numpy()
        for lo, hi in slices(offsets, TEXT_BYTES):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            words = words_of(part, at, True, BLANK)
            if not len(words.hashes):
                continue
            row = np.repeat(np.arange(lo, hi), words.counts)
            hashes = mix(words.hashes ^ salt[lang[row]])
            piece = np.cumsum(BREAK[part], dtype=np.int64)[words.starts]
            ends = np.ones(len(row), bool)
            ends[:-1] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
            yield batch, part, words, row, hashes, ends


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for batch, part, words, row, hashes, _ in _texts(batches):
        found, first, n = np.unique(hashes, return_index=True, return_counts=True)
        size = words.ends[first] - words.starts[first]
        bounds = np.append(0, np.cumsum(size))
        take = np.arange(bounds[-1]) + np.repeat(words.starts[first] - bounds[:-1], size)
        text = pa.StringArray.from_buffers(
            len(found), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(lower[part[take]].tobytes())
        )
        yield pa.RecordBatch.from_arrays(
            [column(batch, "lang").take(pa.array(row[first])), text, pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
            ["lang", "word", "h", "n"],
        )


WORDS = "lang string, word string, h long, n long"


@dataclass
class Codes:
    """Numbers of words: 1 for the most frequent and so on, 0 for words below the least count; without ``hashes`` the hashes themselves."""

    hashes: np.ndarray | None  # ascending
    numbers: np.ndarray | None
    by_number: np.ndarray | None
    heavy: list[np.ndarray]  # by number of words: chained hashes of the prefixes beyond the budget, ascending
    groups: int

    @property
    def bits(self) -> int:
        return 64 if self.hashes is None else max(int(len(self.hashes)).bit_length(), 1)

    def look(self, hashes: np.ndarray) -> np.ndarray:
        if self.hashes is None:
            return np.where(hashes == 0, U(1), hashes)
        if not len(self.hashes):
            return np.zeros(len(hashes), U)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], U(0))

    def names(self, codes: np.ndarray) -> np.ndarray:
        return codes if self.hashes is None else self.by_number[codes.astype(np.int64)]

    def is_heavy(self, chain: np.ndarray, words: int) -> np.ndarray:
        known = self.heavy[words - 1] if words <= len(self.heavy) else np.zeros(0, U)
        if not len(known):
            return np.zeros(len(chain), bool)
        return known[np.minimum(np.searchsorted(known, chain), len(known) - 1)] == chain

    def pack(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """The words of a suffix in as few 64-bit keys as hold them, in order."""
        per = max(64 // self.bits, 1)
        keys = []
        for lo in range(0, DEPTH, per):
            key = np.zeros(len(columns[0]), U)
            for j in range(lo, lo + per):
                key = (key << U(self.bits) if self.bits < 64 else key) | (columns[j] if j < DEPTH else U(0))
            keys.append(key)
        return keys

    def unpack(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        per = max(64 // self.bits, 1)
        mask = U((1 << self.bits) - 1)
        return [(keys[j // per] >> U(self.bits * (per - 1 - j % per))) & mask if per > 1 else keys[j] for j in range(DEPTH)]

    def group_of(self, columns: list[np.ndarray]) -> np.ndarray:
        """The group of each suffix: by its words up to the first prefix that is within the budget."""
        h = chained(np.zeros(len(columns[0]), U), columns[0])
        for d in range(1, DEPTH):
            going = self.is_heavy(h, d)
            if not going.any():
                break
            h = np.where(going, chained(h, columns[d]), h)
        return (h % U(self.groups)).astype(np.int32)


def chained(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of sequences of words, one word longer."""
    return mix(h + words + U(0x9E3779B97F4A7C15))


def _summed(keys: list[np.ndarray], weights: np.ndarray, first: np.ndarray | None = None):
    """Keys in order (of ``first`` before all), equal ones added up."""
    order = np.lexsort([*keys[::-1], *([first] if first is not None else [])])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    weights = np.add.reduceat(weights[order], at) if len(at) else weights
    return [k[at] for k in keys], weights, first[order][at] if first is not None else None


def _to_planes(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, which a shuffle's compression likes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(raw: memoryview, rows: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, rows).T).view(U).reshape(rows)


def _suffixes(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[list[np.ndarray]]:
    """The words of every suffix, by place in it; 0 behind its end."""
    for _, _, _, _, hashes, ends in _texts(batches):
        last = codes.look(hashes)
        columns, open_ = [last], last != 0
        for j in range(1, DEPTH):
            open_ = open_[:-1] & ~ends[j - 1 : -1] if len(open_) > 1 else open_[:0]
            here = np.where(open_, last[j:], U(0))
            open_ = here != 0
            columns.append(np.append(here, np.zeros(len(last) - len(here), U)))
        yield columns


def extensions(shared, words: int):
    """Counts, by task, of the prefixes of so many words that go on from one beyond the budget and may be beyond it themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        total: dict[tuple[int, ...], int] = {}
        for columns in _suffixes(batches, codes):
            ok = columns[words - 1] != 0
            for first in (0, 1):  # all words but the last, and all but the first
                h = np.zeros(len(ok), U)
                for c in columns[first : first + words - 1]:
                    h = chained(h, c)
                ok &= codes.is_heavy(h, words - 1)
            rows = np.stack([codes.names(c[ok]) for c in columns[:words]], 1)
            for key, n in zip(*map(np.ndarray.tolist, np.unique(rows, axis=0, return_counts=True)), strict=True):
                total[tuple(key)] = total.get(tuple(key), 0) + n
        found = list(total)
        for lo in range(0, len(found), 1 << 14):
            some = found[lo : lo + (1 << 14)]
            flat = np.array(some, U).reshape(-1).view(np.int64)
            phrase = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * words), pa.array(flat))
            yield pa.RecordBatch.from_arrays([phrase, pa.array([total[k] for k in some], pa.int64())], ["phrase", "f"])

    return run


def suffix_blocks(shared):
    """Suffixes of the texts, sorted and added up, in blocks for their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = [np.concatenate(k) for k in zip(*held, strict=True)]
            group = codes.group_of(codes.unpack(keys))
            keys, weights, group = _summed(keys, np.ones(len(group), U), group)
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(cuts, np.append(cuts[1:], len(group)), strict=True)])
            ends = np.append(starts[1:], len(group))
            for lo in range(0, len(starts), 256):
                s, e = starts[lo : lo + 256], ends[lo : lo + 256]
                blobs = [b"".join(_to_planes(np.diff(k[a:b], prepend=U(0)) if j == 0 else k[a:b]) for j, k in enumerate([*keys, weights])) for a, b in zip(s, e, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[s]), pa.array((e - s).astype(np.int32)), pa.array(blobs, pa.binary())], ["grp", "rows", "block"]
                )

        for columns in _suffixes(batches, codes):
            keep = np.flatnonzero(columns[1])
            if len(keep):
                held.append(codes.pack([c[keep] for c in columns]))
                rows += len(keep)
            if rows >= BUDGET:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return run


BLOCKS = "grp int, rows int, block binary"


def subtrees(shared, least: int):
    """The nodes of depth 2 and more of every group's subtrees that reach the least count, with their leaf totals. Nodes above a prefix are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        held: list[list[np.ndarray]] = []
        rows, group = 0, None

        def merged():
            keys = [np.concatenate(k) for k in zip(*held, strict=True)]
            keys, weights, _ = _summed(keys[:-1], keys[-1])
            return [*keys, weights]

        def nodes() -> Iterator[pa.RecordBatch]:
            *keys, weights = merged()
            columns = codes.unpack(keys)
            differs, chain = np.ones(len(weights), bool), np.zeros(len(weights), U)
            differs[1:] = False
            for d, c in enumerate(columns, 1):
                differs[1:] |= c[1:] != c[:-1]
                chain = chained(chain, c)
                if d == 1:
                    continue
                at = np.flatnonzero(differs)
                total = np.add.reduceat(weights, at)
                ok = (c[at] != 0) & (total >= least) & ~codes.is_heavy(chain[at], d)
                at, total = at[ok], total[ok]
                for lo in range(0, len(at), 1 << 16):
                    some = at[lo : lo + (1 << 16)]
                    flat = np.stack([codes.names(x[some]) for x in columns[:d]], 1).reshape(-1).view(np.int64)
                    phrase = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * d), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([phrase, pa.array(total[lo : lo + (1 << 16)].astype(np.int64))], ["phrase", "f"])

        for batch in batches:
            for grp, n, block in zip(*(column(batch, c) for c in ("grp", "rows", "block")), strict=True):
                grp, n = grp.as_py(), n.as_py()
                if grp != group and held:
                    yield from nodes()
                    held, rows = [], 0
                group = grp
                raw = memoryview(block.as_buffer())
                keys = [_from_planes(raw[8 * n * j : 8 * n * (j + 1)], n) for j in range(len(raw) // (8 * n))]
                keys[0] = np.cumsum(keys[0], dtype=U)
                held.append(keys)
                rows += n
                if rows >= 2 * BUDGET:
                    held = [merged()]
                    rows = len(held[0][0])
        if held:
            yield from nodes()

    return run


NODES = "phrase array<long>, f long"


def codes_of(words: DataFrame, suffixes: int, least: int, small: int = SMALL_WORDS) -> Codes:
    """Numbers for the words of (h, n) that reach the least count, if they are few enough to be sent to all tasks; and those beyond the budget."""
    frequent = words.filter(F.col("n") >= least)
    groups = max(-(-suffixes // BUDGET), 1)
    bound = max(BUDGET, least)

    def heavy(codes: np.ndarray) -> list[np.ndarray]:
        return [np.sort(chained(np.zeros(len(codes), U), codes))]

    if frequent.count() > small:
        many = frequent.filter(F.col("n") > bound).select("h").collect()
        codes = np.array([r["h"] for r in many], np.int64).view(U)
        return Codes(None, None, None, heavy(np.where(codes == 0, U(1), codes)), groups)
    rows = frequent.select("h", "n").toPandas()
    h, n = rows["h"].to_numpy(np.int64).view(U), rows["n"].to_numpy(np.int64)
    order = np.lexsort([h, -n])
    h, n = h[order], n[order]
    back = np.argsort(h)
    numbers = np.arange(1, len(h) + 1).astype(U)
    return Codes(h[back], (back + 1).astype(U), np.append(U(0), h), heavy(numbers[n > bound]), groups)


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, small: int = SMALL_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two written tables: all words (lang, word, h, n), and the phrases of 2 to ``DEPTH`` words (phrase: hashes, f) that occur ``least`` times or more."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    docs = docs.select(lang, F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    words = docs.mapInArrow(_word_counts, WORDS).groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    words = scratch.write(words, "words")
    suffixes = words.agg(F.sum("n")).first()[0] or 0
    codes = codes_of(words, suffixes, least, small)
    shared = spark.sparkContext.broadcast(codes)
    above = None
    for n in range(2, DEPTH):
        if not len(codes.heavy[-1]):
            break
        longer = docs.mapInArrow(extensions(shared, n), NODES).groupBy("phrase").agg(F.sum("f").alias("f"))
        longer = scratch.write(longer.filter(F.col("f") > max(BUDGET, least)), "above")
        above = longer if above is None else above.unionByName(longer)
        h = np.zeros(longer.count(), U)
        if len(h):  # at most one in BUDGET suffixes
            phrases = np.array([r["phrase"] for r in longer.select("phrase").collect()], np.int64).view(U)
            for c in phrases.T:
                h = chained(h, codes.look(np.ascontiguousarray(c)))
        codes.heavy.append(np.sort(h))
        shared = spark.sparkContext.broadcast(codes)
    blocks = docs.mapInArrow(suffix_blocks(shared), BLOCKS)
    blocks = blocks.repartition(shared.value.groups, "grp").sortWithinPartitions("grp")
    nodes = blocks.mapInArrow(subtrees(shared, least), NODES)
    return words, scratch.write(nodes if above is None else nodes.unionByName(above), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, small: int = SMALL_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language of ``docs`` (lang, text; other columns are ignored).

    A-Z are lower-cased. ``.,;:!?`` and line ends cut a text into pieces, blanks and tabs a piece into words. Per language (NULL is
    ``und``), n counts all words and f(phrase) all its occurrences within pieces, overlapping ones too. Candidates have 2 to ``DEPTH`` words and
    a = f >= ``least``. A cut after k words gives l and r, the f of both parts, and the score floor(1000 * a * n / (l * r)); the lowest counts,
    of equal ones the smallest k. A candidate inside a longer one that occurs as often goes. Ranks go by score, a, and phrase in byte order.
    Every row counts, repeated ones too; a NULL or empty text has no words. No rows, or none that counts, give no rows.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    words, phrases = phrase_counts(docs, scratch, least, small)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = words.filter(F.col("n") >= least).select(F.array("h").alias("part"), F.col("n").alias("pf"), "lang")
    known = single.unionByName(phrases.select(F.col("phrase").alias("part"), F.col("f").alias("pf"), F.lit(None).cast("string").alias("lang")))

    size = F.size("phrase")
    sides = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("is_left"), F.slice("phrase", F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("is_left"), F.slice("phrase", k + 1, size - k).alias("part")),
    )))
    parts = phrases.select("phrase", F.col("f").alias("a"), F.explode(sides).alias("s")).select("phrase", "a", "s.*")
    parts = scratch.write(parts.join(known, "part"), "parts")
    # a phrase that occurs as often one word longer goes; its longer forms lie between, with the same count
    at_end = F.when(F.col("is_left"), F.col("k") == F.size("phrase") - 1).otherwise(F.col("k") == 1)
    inside = parts.filter(at_end & (F.col("pf") == F.col("a"))).select(F.col("part").alias("phrase")).distinct()

    def of(k: int, left: bool):
        return F.max(F.when((F.col("k") == k) & (F.col("is_left") == left), F.col("pf")))

    looked = [of(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, DEPTH) for left in (True, False)]
    cand = parts.groupBy("phrase", "a").agg(F.max("lang").alias("lang"), *looked)
    cand = cand.join(inside, "phrase", "left_anti").join(totals, "lang")

    def cut(k: int):
        quotient = f"(CAST(a AS DECIMAL(19,0)) * CAST(1000 * total AS DECIMAL(19,0))) div (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0)))"
        return F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(F.expr(quotient).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")),
        )

    scored = cand.withColumn("cut", F.array_min(F.array(*[cut(k) for k in range(1, DEPTH)])))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")

    # first within slices of a language, so that no language is one task's work; ties of the last stay for the final order
    best = [F.desc("score"), F.desc("a")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("place") <= top)
    some = some.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("place") <= top)
    some = scratch.write(some.drop("salt", "place"), "best")
    names = words.filter(F.col("n") >= least).select("h", "word")
    spelled = some.select("phrase", F.posexplode("phrase").alias("i", "h")).join(names, "h")
    spelled = spelled.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("ws"))
    spelled = spelled.select("phrase", F.array_join(F.col("ws.word"), " ").alias("spelled"))
    ranked = some.join(spelled, "phrase").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "spelled")))
    return ranked.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("spelled").alias("phrase"), "a", "l", "r", "n", "score"
    )
