"""Windows of words over a batch of texts, and the minimizers that bring equal windows together. All by array operations."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def split(text: str | None) -> list[bytes]:
    """The words of one text, as UTF-8: runs without U+0020 and U+0009-U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


@dataclass
class Words:
    """The words of some texts: byte ranges in one buffer, where single spaces part them, a hash for each, and where each text's words begin."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # one more than there are texts

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by single spaces."""
        return self.data[self.start[a] : self.end[b - 1]]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown by doubling."""
    for k, base in enumerate((_BASE, _INVERSE)):
        while len(_powers[k]) < n:
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, len(_powers[k]), 1 << 64))])
    return _powers[0], _powers[1]


def words_of(texts: list[str | None]) -> Words:
    """Words are runs without U+0020 and U+0009-U+000D; a null text has none.

    A word's hash is a polynomial over its bytes, taken from running sums. Equal words have equal hashes; that unequal
    ones seldom do saves work and decides nothing.
    """
    parts = [b" ".join(split(t)) for t in texts]
    data = b" ".join([b"", *parts, b""])
    raw = np.frombuffer(data, dtype=np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    hashes = (sums[end] - sums[start]) * down[start]
    hashes ^= hashes >> np.uint64(31)
    at = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return Words(data, start, end, hashes, np.searchsorted(start, at))


def minimizers(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window's first word, place, value): each window within one text with the least hash among its runs of `gram` words, the first of equal ones.

    Equal windows have equal minimizers, at the same place in the window.
    """
    none = np.empty(0, np.int64)
    n = len(w.hashes) - window + 1
    if n <= 0:
        return none, none, none
    g, base = np.zeros(len(w.hashes) - gram + 1, dtype=np.uint64), np.uint64(_BASE)
    for k in range(gram):
        g = (g * base) ^ w.hashes[k : k + len(g)]
        g ^= g >> np.uint64(29)
    g *= base
    g ^= g >> np.uint64(32)
    least, place = g[:n].copy(), np.arange(n)
    for k in range(1, window - gram + 1):
        other = g[k : k + n]
        less = np.flatnonzero(other < least)
        least[less] = other[less]
        place[less] = less + k
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    inside = np.flatnonzero(text[:n] == text[window - 1 :])
    return inside, place[inside], least[inside].view(np.int64)


def digest(words: bytes) -> bytes:
    """16 bytes that stand for words joined by single spaces where they are compared: a cryptographic hash, so unequal words can't be made to agree."""
    return blake2b(words, digest_size=16).digest()


def run_digests(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The digest of words a[k] to b[k] for each k, as two longs."""
    data = w.data
    whole = b"".join([blake2b(data[i:j], digest_size=16).digest() for i, j in zip(w.start[a].tolist(), w.end[b - 1].tolist(), strict=True)])
    return np.frombuffer(whole, dtype=np.int64).reshape(-1, 2)


def runs(first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[a, b) of the runs of neighbouring windows with one minimizer."""
    if not len(first):
        return first, first
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(first) != 1)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(first)]])
