"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn, encoded once with character offsets, and the sorted
spans of the assistant texts are intersected with the token spans by binary search: a token is under the loss mask where it overlaps such a
span. Control strings inside roles and texts are escaped by one more backslash between ``<`` and ``|``, so a text can never open or close
a turn and everything can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import column
from rowtrail.llm.tokens import encoder, vocabulary

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PART_CHARS = 1 << 20
"""A conversation longer than this comes in several parts, cut between turns, where no pre-token reaches across."""
FORMATTED = (
    "conv_id long, part int, last boolean, formatted string, input_ids array<int>, loss_mask array<boolean>, "
    "loss_spans array<struct<start:int,end:int>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the sorted spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns = []
    for turn in formatted.split(OPEN)[1:]:
        role, _, text = turn.removesuffix(CLOSE).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens overlap a span, and the parts of the spans that these tokens cover."""
    on = np.zeros(len(offsets), bool)
    covered = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for lo, hi in spans:
        x, y = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(starts, hi, side="left"))
        if x < y and lo < hi:
            on[x:y] = True
            covered.append((max(lo, int(starts[x])), min(hi, int(ends[y - 1]))))
    return on, covered


def format_chats(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, part, last, formatted, input_ids, loss_mask (by token), loss_spans (of characters in ``formatted``).

    ``conversations`` has a row per turn: conv_id, turn, role, text; other columns are ignored. Turns go by turn, then role and text where
    turns tie; repeated rows are repeated turns. A NULL role or text is empty; a NULL turn comes first; rows without conv_id are one
    conversation. Special strings inside texts are ordinary text. A conversation of up to ``PART_CHARS`` characters is one row; longer ones
    have parts 0, 1, … cut between turns, and are streamed: a task holds one part at a time. No rows give no rows.
    """
    path = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoder(path)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True

        def row(conv, part, last, turns):
            text, spans = render(turns)
            got = library.encode(text, add_special_tokens=False)
            on, covered = mask(np.array(got.offsets, np.int64).reshape(-1, 2), spans)
            found = {
                "conv_id": conv, "part": part, "last": last, "formatted": text, "input_ids": got.ids, "loss_mask": on.tolist(),
                "loss_spans": [{"start": x, "end": y} for x, y in covered],
            }
            return pa.RecordBatch.from_pylist([found], schema=SCHEMA)

        conv, part, turns, size, began = None, 0, [], 0, False
        for batch in batches:
            for c, role, text in zip(*(column(batch, n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if began and c != conv:
                    yield row(conv, part, True, turns)
                    part, turns, size = 0, [], 0
                elif size > PART_CHARS:
                    yield row(conv, part, False, turns)
                    part, turns, size = part + 1, [], 0
                conv, began = c, True
                turns.append((role or "", text or ""))
                size += len(turns[-1][1]) + len(turns[-1][0])
        if began:
            yield row(conv, part, True, turns)

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    whole = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return whole.mapInArrow(run, FORMATTED)


SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()),
        ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
    n = loss = chars = 0
    for batch in batches:
        rows = []
        for conv, last, text, spans in zip(
            *(column(batch, c).to_pylist() for c in ("conv_id", "last", "formatted", "loss_spans")), strict=True
        ):
            for role, said in read_back(text):
                turns_hash.update(f"{role}\n{said}\n".encode())
                n += 1
            for s in spans:
                under = unescape(text[s["start"] : s["end"]])
                loss_hash.update(under.encode())
                loss += len(under)
            chars += len(text)
            if last:
                rows.append((conv, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
                turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                n = loss = chars = 0
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of ``format_chats``: digests of its turns and of the text under the mask.

    It follows ``format_chats`` directly, so that the parts of a conversation come one after the other in one task.
    """
    return formatted.mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
