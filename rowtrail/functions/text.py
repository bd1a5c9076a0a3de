"""Character n-grams and the numbers made of them, as column expressions over whole texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MERSENNE = (1 << 31) - 1
GRAM_FACTOR = 1_048_583
PIECE_CHARS = 1 << 18
"""Longer texts are worked on in pieces of so many characters."""


def char_ngrams(text: Column, n: int) -> Column:
    """All n-grams of consecutive characters, repeats included. Linear in the length of the text."""
    chars = F.split(text, "")
    length = F.char_length(text)
    count = F.greatest(length - (n - 1), F.lit(0))
    shifted = [F.slice(chars, F.lit(i + 1), count) for i in range(n)]
    grams = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), shifted)
    return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))


def gram_pieces(text: Column, high: int) -> Column:
    """Pieces of a text that overlap by ``high`` - 1 characters: ``piece_grams`` of all of them are the text's n-grams."""
    size = PIECE_CHARS

    def cut(texts):
        return texts.map(lambda x: [x[i : i + size + high - 1] for i in range(0, len(x), size)])

    return F.pandas_udf(cut, "array<string>")(text)


def piece_grams(piece: Column, low: int, high: int) -> Column:
    """The n-grams that start in the first ``PIECE_CHARS`` characters."""
    return F.concat(*[char_ngrams(F.substring(piece, 1, PIECE_CHARS + n - 1), n) for n in range(low, high + 1)])


def word_pieces(text: Column) -> Column:
    """A text cut at blanks, which are left out there: the pieces split at blanks are the words of the text split at blanks."""
    size = PIECE_CHARS

    def pieces(x):
        blank, out, start = re.compile(r"[ \t\n\x0b\f\r]+"), [], 0
        while len(x) - start > size:
            found = blank.search(x, start + size)
            if found is None or found.end() == len(x):
                break
            out.append(x[start : found.start()].rstrip(" \t\n\x0b\f\r"))
            start = found.end()
        return [*out, x[start:]]

    return F.pandas_udf(lambda texts: texts.map(pieces), "array<string>")(text)


def ngram_range(text: Column, low: int, high: int) -> Column:
    return F.concat(*[char_ngrams(text, n) for n in range(low, high + 1)])


def trigram_set(text: Column, tag: str = "") -> Column:
    """Distinct 3-grams of the lower-cased text with two spaces on each side, each behind ``tag``."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    grams = F.array_distinct(char_ngrams(padded, 3))
    return F.transform(grams, lambda g: F.concat(F.lit(tag), g)) if tag else grams


def hash_factors(n: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each of ``n`` linear hash functions modulo 2^31 - 1."""
    return [((i + 1) * 1103515245 % MERSENNE, (i + 1) * 12345 % MERSENNE) for i in range(n)]


def min_hashes(text: Column, n: int, low: int = 2, high: int = 4) -> Column:
    """Array of ``n`` values in [0, 1): per hash function the smallest value over the text's n-grams.

    A gram's number folds its code points: h = (h * GRAM_FACTOR + code) mod 2^31 - 1, starting from the gram
    length. A text without n-grams gives zeros. Built-in array functions express this too, but take about
    twenty times as long as numpy on Arrow batches: they interpret one lambda call per gram and function.
    """
    factors, prime, step = hash_factors(n), MERSENNE, GRAM_FACTOR

    def signatures(texts):
        import numpy as np

        def signature(value: str) -> list[float]:
            # pieces share the grams across their borders
            pieces = [value[i : i + PIECE_CHARS + high - 1] for i in range(0, len(value), PIECE_CHARS)] or [""]
            # only the last may be too short for a gram, and only where there are others
            return np.min([of_piece(p) for p in pieces if len(p) >= low or len(pieces) == 1], axis=0).tolist()

        def of_piece(value: str) -> list[float]:
            codes = np.frombuffer(value.encode("utf-32-le"), dtype="<u4").astype(np.int64)
            numbers = [np.empty(0, np.int64)]
            for k in range(low, high + 1):
                h = np.full(max(0, len(codes) - k + 1), k, np.int64)
                for i in range(k):
                    h = (h * step + codes[i : i + len(h)]) % prime
                numbers.append(h)
            grams = np.unique(np.concatenate(numbers))
            if not len(grams):
                return [0.0] * n
            if len(grams) <= 2048:  # all functions at once while the table stays in cache
                return (((grams[:, None] * many[0] + many[1]) % prime).min(axis=0) / prime).tolist()
            return [float(((grams * a + b) % prime).min()) / prime for a, b in factors]

        many = np.array(factors, np.int64).T
        known = {v: signature(v) for v in texts.unique()}
        return texts.map(known)

    return F.pandas_udf(signatures, "array<double>")(text)
