"""Word shingles of whole texts as sorted arrays of distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import mix64

WORDS = 5
#: Lower-cases A-Z and makes every separator a blank.
_TABLE = bytes(b | 0x20 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
#: Keeps the case.
CASED = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_MULTIPLIERS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(WORDS)]
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, x, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes], table: bytes = _TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text.

    Words are runs of anything but blank and bytes 9 to 13.
    """
    flat = np.frombuffer(b" ".join([b"", *texts, b""]).translate(table), np.uint8)
    word = flat != 0x20
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    up, down = _tables(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    h = mix64(h + (stop - start).astype(np.uint64) * np.uint64(_BASE))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends + 1)
    return h, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer words is one shingle of them all; one without words has none.
    """
    h, counts = word_hashes(texts)
    if len(h) >= words:
        rolled = h[: len(h) - words + 1] * _MULTIPLIERS[0]
        for k in range(1, words):
            rolled = rolled + h[k : len(h) - words + 1 + k] * _MULTIPLIERS[k]
        rolled = mix64(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            own = np.sort(rolled[at : at + n - words + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            total = np.full(1, n, np.uint64)
            for k in range(n):
                total = total + h[at + k : at + k + 1] * _MULTIPLIERS[k]
            out.append(mix64(total))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
