"""Marginal probabilities of words under a unigram model of pieces, for many words at once.

The lattice of a word has an edge for every piece that matches a run of its characters, and each path
is a segmentation. The forward recursion in log space sums over all paths. Words of equal length are rows of one
matrix; a polynomial rolling hash turns each run into a number that is looked up among the pieces of that length.
A character that is no piece has one edge of byte pieces.
"""
from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
BEGIN = "▁"


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of the rows; column j covers the first j characters."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j]
    return out


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length).astype(np.uint64)


class Lattice:
    """`pieces` are distinct texts; the last entry of a vector over them stands for any single byte."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        by_length: dict[int, list[tuple[str, int]]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append((piece, i))
        self.table = {}
        for length, found in by_length.items():
            hashes = _hash(_codes([p for p, _ in found], length))[:, -1]
            order = np.argsort(hashes)
            # Most runs are no piece; a bit for some bits of the hash tells so without a search.
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[hashes * _SPREAD >> np.uint64(44)] = True
            self.table[length] = hashes[order], np.array([i for _, i in found])[order], maybe
        self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(self.table), _BASE))))

    def _edges(self, codes: np.ndarray, log_p: np.ndarray):
        """For each end j the edges that end there: start, rows, piece of each row, its log probability, bytes or None."""
        prefix = _hash(codes)
        width = np.array([1, 2, 3, 4])[np.searchsorted([0x80, 0x800, 0x10000], codes, side="right")]
        for j in range(1, codes.shape[1] + 1):
            edges = []
            for length, (hashes, ids, maybe) in self.table.items():
                if length > j:
                    continue
                key = prefix[:, j] - prefix[:, j - length] * self.powers[length]
                rows = np.flatnonzero(maybe[key * _SPREAD >> np.uint64(44)])
                at = np.minimum(np.searchsorted(hashes, key[rows]), len(hashes) - 1)
                same = hashes[at] == key[rows]
                rows, piece = rows[same], ids[at[same]]
                if len(rows):
                    edges.append((j - length, rows, piece, log_p[piece], None))
                if length == 1 and len(rows) < len(codes):
                    other = np.delete(np.arange(len(codes)), rows)
                    n_bytes = width[other, j - 1]
                    edges.append((j - 1, other, None, n_bytes * log_p[-1], n_bytes))
            yield j, edges

    def log_probabilities(self, words: list[str], log_p: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The natural log probability of each word, and the pieces expected in `counts` copies of them.

        A word is given without the mark of its beginning. Without counts the second vector is zero.
        """
        total, expected = np.zeros(len(words)), np.zeros(self.size)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            step = max(1, 2_000_000 // int(lengths[order[a]]) ** 2)
            for start in range(a, b, step):
                rows = order[start:min(b, start + step)]
                codes = _codes([BEGIN + words[i] for i in rows], int(lengths[rows[0]]))
                total[rows] = self._forward(codes, log_p, None if counts is None else counts[rows], expected)
        return total, expected

    def _forward(self, codes: np.ndarray, log_p: np.ndarray, counts: np.ndarray | None, expected: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        ahead = np.full((length + 1, n), -np.inf)
        ahead[0] = 0.0
        steps = []
        for j, edges in self._edges(codes, log_p):
            for i, rows, _, weight, _ in edges:
                ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + weight)
            if counts is not None:
                steps.append((j, edges))
        if counts is not None:
            back = np.full((length + 1, n), -np.inf)
            back[length] = 0.0
            for j, edges in reversed(steps):
                for i, rows, piece, weight, n_bytes in edges:
                    back[i, rows] = np.logaddexp(back[i, rows], back[j, rows] + weight)
                    share = counts[rows] * np.exp(ahead[i, rows] + weight + back[j, rows] - ahead[length, rows])
                    if piece is None:
                        expected[-1] += share @ n_bytes
                    else:
                        np.add.at(expected, piece, share)
        return ahead[length]
