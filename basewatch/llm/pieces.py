"""The pieces of a public vocabulary, looked up for many substrings at once."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

MARK = "▁"
#: Words up to so many characters, the mark included, are handled as rows of a matrix.
WIDE = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS_BITS = 20


def load_pieces(path: str) -> list[str]:
    """The pieces in the file's order, without control pieces and bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def zipf_log_probs(n: int) -> np.ndarray:
    """Piece number r of n has probability in proportion to 1 / (r + 2.7)."""
    p = 1 / (np.arange(n) + 2.7)
    return np.log(p / p.sum())


class Words:
    """Words as a matrix of code points with prefix hashes; no word is longer than WIDE or holds U+0000."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.lengths.max(initial=1))
        self.codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
        self.hashes = np.zeros((width + 1, len(words)), np.uint64)
        for d in range(width):
            self.hashes[d + 1] = self.hashes[d] * _BASE + self.codes[:, d]

    @property
    def width(self) -> int:
        return self.codes.shape[1]

    def substring(self, rows: np.ndarray, end: int, k: int) -> np.ndarray:
        """Hashes of the k characters before position end."""
        return self.hashes[end][rows] - self.hashes[end - k][rows] * self.powers[k]

    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(WIDE, _BASE, np.uint64), dtype=np.uint64)])


class PieceTable:
    def __init__(self, path: str):
        self.pieces = load_pieces(path)
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = min(WIDE, max(map(len, self.pieces)))
        fits = [i for i, p in enumerate(self.pieces) if len(p) <= WIDE]
        w = Words([self.pieces[i] for i in fits])
        hashes = w.hashes[w.lengths, np.arange(len(fits))]
        self.keys = np.zeros((4, 1 << _SLOTS_BITS), np.uint64)
        self.values = np.full((4, 1 << _SLOTS_BITS), -1, np.int32)
        slots = self._slots(hashes)
        for i, s, h in zip(fits, slots.tolist(), hashes.tolist(), strict=True):
            row = next(r for r in range(4) if self.values[r, s] < 0)
            self.keys[row, s], self.values[row, s] = h, i
        self.rows = int((self.values >= 0).any(axis=1).sum())

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        slots = self._slots(hashes)
        out = np.where(self.keys[0][slots] == hashes, self.values[0][slots], -1)
        for r in range(1, self.rows):
            more = self.values[r][slots]
            out = np.where((more >= 0) & (self.keys[r][slots] == hashes), more, out)
        return out


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def unknown_log_prob(n: int) -> float:
    """Of each byte of a character that is no piece."""
    return float(zipf_log_probs(n)[-1]) - math.log(2e4)
