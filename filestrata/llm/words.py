"""Words of many texts at once as 64-bit hashes, computed over the UTF-8 bytes with numpy.

A word is a run of bytes outside a set of separators; white space is 0x20 and 0x09 to 0x0D. Each byte of
a word is multiplied by a random odd number of its place, the products are summed and mixed, so
different words have the same hash with a chance of 2^-64.
"""
from __future__ import annotations

import numpy as np

_PLACES = 4096
#: Words hashed at a time, so few that their letters as wide numbers stay in a processor's cache.
_RUN = 32_768
_RANDOM = np.random.default_rng(20240229)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: Separators that leave runs of ASCII letters, digits and all bytes of other characters.
_NOT_ALNUM = np.ones(256, dtype=bool)
_NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """`hashes` of all words in order; text i has the words `first[i]` to `first[i + 1]`.

    `begin` and `end` are byte places in `joined`, the texts with a line feed after each.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, alnum: bool = False):
        self.joined = b"\n".join(texts) + b"\n"
        codes = np.frombuffer(self.joined, dtype=np.uint8)
        inside = ~(_NOT_ALNUM if alnum else _WHITE)[codes]
        change = np.diff(np.concatenate(([False], inside)).view(np.int8), append=0)
        self.begin = np.flatnonzero(change[:-1] == 1)
        self.end = np.flatnonzero(change[:-1] == -1)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.begin, self.offset)
        table = _LOWER if lower else _SAME
        runs = range(0, len(self.begin), _RUN)
        self.hashes = np.concatenate([self._hashed(codes, inside, table, i, i + _RUN) for i in runs] or [np.zeros(0, dtype=np.uint64)])

    def _hashed(self, codes: np.ndarray, inside: np.ndarray, table: np.ndarray, start: int, stop: int) -> np.ndarray:
        """The hashes of some words, so that wide numbers are held for a few bytes at a time."""
        lengths = self.end[start:stop] - self.begin[start:stop]
        part = slice(self.begin[start], self.end[start:stop][-1])
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(at, lengths)
        factor = _MULTIPLIERS[place & (_PLACES - 1)]
        if lengths.max() > _PLACES:
            factor = factor * (2 * (place // _PLACES) + 1).astype(np.uint64)
        letters = table[codes[part][inside[part]]].astype(np.uint64)
        return mixed(np.add.reduceat(factor * (letters + np.uint64(1)), at))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.joined[self.begin[i]:self.end[i]]


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """One hash of a short sequence of words, its length included."""
    n = len(hashes)
    return mixed(np.array([np.sum(hashes * _ORDER[:n], dtype=np.uint64)]) + _ORDER[63:] * np.uint64(n))[0]


def window_hashes(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The hash of each run of `size` words; the caller leaves out runs that cross texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.repeat(_ORDER[63:] * np.uint64(size), n)
    for j in range(size):
        total += hashes[j:j + n] * _ORDER[j]
    return mixed(total)
