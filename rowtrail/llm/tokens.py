"""Token counts and ids of a byte-level BPE tokenizer, with a shortcut for pre-tokens that are one token as a whole.

The library splits a text into pre-tokens and merges inside each of them, so a text's ids are those of its pre-tokens in a row. When a
worker loads the vocabulary it proves which strings of it encode alone as just their own token; pre-tokens among these need no merging.
All others go to the library's model once per worker and are remembered. Splitting is done here only for characters whose class
(letter, digit, blank, other) was read off the library itself; a text with any other character, or with the text of an added token,
goes to the library as a whole. So results are the library's in every case.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import column

VOCABULARY = "byte_bpe_50k.json"
PROVEN_BELOW = 0x250
"""Characters below this code point are classified by asking the library when a worker starts."""
REMEMBERED = 250_000
"""Merged pre-tokens that a worker remembers in each of two generations."""


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in kept}
    others = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + i) for i, b in enumerate(others)}


class Merged(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes; unknown ones are merged by the library's model.

    Two generations are remembered: when the younger is full it becomes the older, so what comes often stays.
    """

    def __init__(self, model, whole: dict[str, bytes]):
        super().__init__(whole)
        self.model, self.whole, self.older = model, whole, {}
        self.letters = byte_letters()

    def __missing__(self, pretoken: str) -> bytes:
        ids = self.older.get(pretoken)
        if ids is None:
            found = self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.letters))
            ids = array("I", [t.id for t in found]).tobytes()
        if len(self) >= REMEMBERED + len(self.whole):
            self.older = dict(self)
            self.clear()
            self.update(self.whole)
        self[pretoken] = ids
        return ids


class Encoder:
    """Ids of whole texts as the tokenizers library gives them without special tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = byte_letters()
        self.merged = Merged(self.library.model, self._whole(letters))
        self.split, self.foreign = self._splitter()

    def _whole(self, letters: dict[int, str]) -> dict[str, bytes]:
        """Vocabulary strings that the model keeps as one token."""
        back = {c: b for b, c in letters.items()}
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are kept as little-endian 32-bit numbers")
        proven = {}
        for text, i in self.library.get_vocab(with_added_tokens=False).items():
            if any(c not in back for c in text):
                continue
            found = self.library.model.tokenize(text)
            if len(found) == 1 and found[0].id == i:
                try:
                    proven[bytes(back[c] for c in text).decode()] = np.array([i], "<u4").tobytes()
                except UnicodeDecodeError:
                    continue  # part of a character; no pre-token is equal to it
        return proven

    def _splitter(self):
        """A pattern for pre-tokens, and one for characters outside the proven range."""
        cut = self.library.pre_tokenizer.pre_tokenize_str
        kinds: dict[str, list[int]] = {"letter": [], "digit": [], "other": [], "blank": []}
        for code in range(PROVEN_BELOW):
            c = chr(code)
            kind = "letter" if len(cut("a" + c)) == 1 else "digit" if len(cut("1" + c)) == 1 else "other" if len(cut("." + c)) == 1 else "blank"
            kinds[kind].append(code)
        letter, digit, blank = (_ranges(kinds[k]) for k in ("letter", "digit", "blank"))
        # the pre-token pattern of byte-level BPE, with its classes written out
        pattern = (
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
        )
        return re.compile(pattern).findall, re.compile(f"[^{_ranges(list(range(PROVEN_BELOW)))}]").search

    def ids(self, text: str) -> bytes:
        """The text's ids, four bytes each."""
        if self.foreign(text) or any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.merged.__getitem__, self.split(text)))


def _ranges(codes: list[int]) -> str:
    """A character class body."""
    out, lo = [], None
    for i, c in enumerate(codes):
        lo = c if lo is None else lo
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{lo:08x}-\\U{c:08x}")
            lo = None
    return "".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row of ``docs`` (doc_id, text; others are ignored).

    Counts are those of the tokenizers library for the vocabulary at ``path``, without special tokens added; texts of special tokens
    inside a text count as the library counts them by default. A NULL or empty text has no bytes and no tokens. Rows are taken as they
    are: equal rows and a NULL doc_id come back as such. One pass without a shuffle.
    """
    path = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for batch in batches:
            texts = column(batch, "text")
            counts = [len(ids(t.as_py() or "")) // 4 for t in texts]
            bytes_ = [len((t.as_py() or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), pa.array(bytes_, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
