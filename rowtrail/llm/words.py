"""Words of whole batches of texts, and hashes of runs of words, in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. In UTF-8 these bytes never occur inside a longer
character, so byte positions are enough. Word hashes are 64 bits, mixed over eight bytes at a time; runs of words are hashed by
a polynomial over the word hashes, from prefix sums, so that every run length costs the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SEPARATOR = BLANK.copy()
SEPARATOR[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)
BASE = 0x9E3779B97F4A7C1B  # odd; BASE - 1 is divisible by 2 only, so neighbouring powers differ in nearly all bits
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    """of^0 … of^(n-1) modulo 2^64."""
    have = _powers.get(of)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, of, U)
        steps[0] = 1
        have = _powers[of] = np.multiply.accumulate(steps)
    return have[:n]


@dataclass
class Words:
    """``hashes``, ``starts`` and ``ends`` of all words; those of text i are [bounds[i], bounds[i + 1])."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within one text, and n + 1 bounds by text. Run j of text i starts at its word j."""
        n = len(self.hashes)
        counts = np.maximum(self.counts - (k - 1), 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if not bounds[-1]:
            return np.zeros(0, U), bounds
        sums = np.zeros(n + 1, U)
        np.cumsum(self.hashes * powers(BASE, n), out=sums[1:])
        value = (sums[k:] - sums[:-k]) * powers(INVERSE, n + 1 - k)
        if len(counts) > 1:
            first = np.repeat(self.bounds[:-1] - bounds[:-1], counts)
            value = value[np.arange(bounds[-1]) + first]
        return mix(value + U(k)), bounds


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = BLANK) -> Words:
    """The words of texts lying one after the other in ``data``; ``lower`` folds A-Z, ``blank`` marks the bytes between words."""
    n = len(data)
    if not n:
        return Words(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    solid = ~blank[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = LOWER[data] if lower else data
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix((eight[starts] & KEEP[np.minimum(size, 8)]) + U(BASE) * size.astype(U))
    at = np.flatnonzero(size > 8)
    done = 8
    while len(at):
        part = eight[starts[at] + done] & KEEP[np.minimum(size[at] - done, 8)]
        h[at] = mix((h[at] ^ part) + U(BASE))
        done += 8
        at = at[size[at] > done]
    return Words(h, starts, ends, np.searchsorted(starts, offsets))


def sliding(x: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours; ``len(x) - width + 1`` values."""
    pick = np.minimum if least else np.maximum
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[:-rest], x[rest:]) if rest else x


def digests(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each text's hashes, whatever their order."""
    return segment_sum(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), bounds), segment_sum(mix(hashes + U(0x632BE59BD9B4E019)), bounds)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
