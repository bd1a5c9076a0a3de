"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text into chunks where it is one below a multiple of the block size; each chunk gives one of
64 characters. So an edit changes the characters of the chunks it touches and leaves all others. The block size is the smallest of
3 * 2^k that gives half of ``LETTERS`` characters at most on average, so that it changes by one step at most when a text is halved, and
the fingerprint is ``size:signature:signature at twice the size``. Two fingerprints are compared where they have a block size in common,
by edit distance (insertions and deletions) of the signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowtrail.llm.shared import Scratch, column
from rowtrail.llm.words import U, mix, powers

SMALLEST, LETTERS, REACH = 3, 64, 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
CHUNK_BASE = 0xC2B2AE3D27D4EB4F


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the seven bytes up to each byte; bytes before the text are zero."""
    x = data.astype(np.uint32)
    padded = np.concatenate([np.zeros(REACH - 1, np.uint32), x])
    n = len(x)
    total, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for back in range(REACH):
        part = padded[REACH - 1 - back : REACH - 1 - back + n]
        total += part
        weighted += np.uint32(REACH - back) * part
        shifted ^= part << np.uint32(5 * back)
    return total + weighted + shifted


def signature(data: np.ndarray, roll: np.ndarray, size: int) -> str:
    """One letter per chunk at this block size, the last for what is left at the end, if anything is."""
    ends = np.flatnonzero(roll % np.uint32(size) == size - 1) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    if not len(ends):
        return ""
    starts = np.concatenate([[0], ends[:-1]])
    places = np.arange(len(data)) - np.repeat(starts, ends - starts)
    hashes = mix(np.add.reduceat((data.astype(U) + U(1)) * powers(CHUNK_BASE, len(data))[places], starts))
    return ALPHABET[(hashes >> U(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: np.ndarray) -> str:
    """The fingerprint of the bytes of one text. The empty text has the fingerprint ``3::``."""
    roll = rolling(data)
    size = SMALLEST
    while size * LETTERS < 2 * len(data):
        size *= 2
    return f"{size}:{_short(signature(data, roll, size))}:{_short(signature(data, roll, 2 * size))}"


def _short(letters: str) -> str:
    """Runs of one letter tell little; more than three in a row count as three. Of what still exceeds ``LETTERS``, as only a text of one
    repeating pattern has, blocks of letters are hashed to one each."""
    out: list[str] = []
    for c in letters:
        if len(out) < 3 or not c == out[-1] == out[-2] == out[-3]:
            out.append(c)
    if len(out) <= LETTERS:
        return "".join(out)
    each = -(-len(out) // LETTERS)
    return "".join(
        chr(ALPHABET[hashlib.blake2b("".join(out[i : i + each]).encode(), digest_size=1).digest()[0] % 64]) for i in range(0, len(out), each)
    )


def common(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures of up to 64 letters, bit by bit for all pairs at once."""
    n = len(pairs)
    place = np.zeros((n, 128), U)
    other = np.zeros((n, LETTERS), np.uint8)
    for i, (a, b) in enumerate(pairs):
        x = np.frombuffer(a.encode(), np.uint8)
        np.bitwise_or.at(place[i], x, U(1) << np.arange(len(x), dtype=U))
        other[i, : len(b)] = np.frombuffer(b.encode(), np.uint8)
    left = np.full(n, 2**64 - 1, U)
    rows = np.arange(n)
    for j in range(LETTERS):
        match = left & place[rows, other[:, j]]  # letter 0 stands nowhere
        left = (left + match) | (left - match)
    return np.bitwise_count(~left).astype(np.int64)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: 1 for equal ones, 0 where no block size is shared or no stretch of letters is.

    It is 1 - distance / (sum of lengths), the distance being the letters to delete and insert, and the better of the shared block sizes.
    Signatures must share seven letters in a row, or a quarter of the shorter one's where that is less, else the likeness is 0.
    """
    out = np.zeros(len(pairs))
    todo, owner = [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
        a, b = int(a), int(b)
        both = [(a1, b1), (a2, b2)] if a == b else [(a1, b2)] if a == 2 * b else [(a2, b1)] if b == 2 * a else []
        for s, t in both:
            if s and t and _share(s, t):
                todo.append((s, t))
                owner.append(i)
    if todo:
        score = 2 * common(todo) / np.array([len(s) + len(t) for s, t in todo])
        np.maximum.at(out, owner, np.minimum(score, 1.0))
    return out


def _share(s: str, t: str) -> bool:
    k = max(1, min(7, min(len(s), len(t)) // 4))
    return not {s[i : i + k] for i in range(len(s) - k + 1)}.isdisjoint(t[i : i + k] for i in range(len(t) - k + 1))


DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PENDING = f"{DONE}, task int, kind string, text string"


def _edit(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _rows(ids: list, texts: list[str], prints: list[str], afters: list[str], after_prints: list[str]) -> list[list]:
    edited = [_edit(t, a).encode() for t, a in zip(texts, afters, strict=True)]
    edited_prints = [fingerprint(np.frombuffer(e, np.uint8)) for e in edited]
    scores = likeness(list(zip(prints, edited_prints, strict=True)) + list(zip(prints, after_prints, strict=True)))
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], prints, edited_prints,
        scores[: len(ids)].tolist(), scores[len(ids) :].tolist(),
    ]


STEP = 500


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each is done with the next; the first and last of a task are left over, to be joined to the neighbouring tasks'."""
    task = TaskContext.get().partitionId()
    schema = pa.schema(
        [(n, pa.int64() if k == "long" else pa.int32() if k == "int" else pa.float64() if k == "double" else pa.string())
         for n, k in (c.split() for c in PENDING.split(", "))]
    )

    def left(kind, doc, text, print_):
        row = {"doc_id": doc, "fingerprint": print_, "task": task, "kind": kind, "text": text}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            ids = column(part, "doc_id").to_pylist()
            texts = [t or "" for t in column(part, "text").to_pylist()]
            prints = [fingerprint(np.frombuffer(t.encode(), np.uint8)) for t in texts]
            if held is None:
                yield left("first", ids[0], texts[0], prints[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            held = ids[-1], texts[-1], prints[-1]
            if len(ids) > 1:
                rows = _rows(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                n = len(ids) - 1
                rows += [[task] * n, ["done"] * n, [None] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
    if held is not None:
        yield left("last", *held)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda n: column(batch, n).to_pylist()
        rows = _rows(get("doc_id"), get("text"), get("fingerprint"), get("after"), get("after_print"))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in DONE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; one row per row of ``docs`` (doc_id, text; others ignored).

    The edited text of a document has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's text, by doc_id; the first document follows the last. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A NULL text is empty. Rows with one doc_id are ordered by text, and a NULL doc_id comes
    first. A single row is its own next. No rows give no rows.

    One range sort on doc_id puts neighbours into one task; only the last row of each task still needs the first of the next, and these
    two rows per task are matched in a table as long as there are tasks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    pieces = scratch.write(ordered.mapInArrow(_ordered, PENDING), "pieces")
    firsts = pieces.filter("kind = 'first'")
    order = Window.orderBy("task")
    start = F.first("task").over(order)
    nexts = firsts.select("task", F.lead("task").over(order).alias("next_task"), start.alias("start"))
    nexts = nexts.select("task", F.coalesce("next_task", "start").alias("next_task"))
    heads = firsts.select(F.col("task").alias("next_task"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    lasts = pieces.filter("kind = 'last'").select("doc_id", "text", "fingerprint", "task")
    bounds = lasts.join(nexts, "task").join(heads, "next_task").select("doc_id", "text", "fingerprint", "after", "after_print")
    names = [c.split()[0] for c in DONE.split(", ")]
    return pieces.filter("kind = 'done'").select(*names).unionByName(bounds.mapInArrow(_joined, DONE))
