"""Word shingles as 64-bit hashes, by numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from . import common

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = common.mix(np.arange(256, dtype=np.uint64), 11)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _BASE, np.uint64)]), dtype=np.uint64)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, A-Z lower-cased, and the number of words of each text."""
    raw = [(t or "").encode().lower() for t in texts]
    sizes = np.array([len(x) + 1 for x in raw])
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = ~_SEPARATES[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, np.cumsum(sizes))]))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    at = np.flatnonzero(inside)
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_LETTER[b[at]] * powers(int(size.max()))[place], first)
        return common.mix(h ^ size.astype(np.uint64), 12), counts


def sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """The distinct k-word shingles of each text, sorted; the whole text as one if it has fewer words."""
    h, counts = words(texts)
    ends = np.cumsum(counts)
    out = []
    if len(h) >= k:
        with np.errstate(over="ignore"):
            s = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                s = s * _BASE + h[j : len(h) - k + 1 + j]
            s = common.mix(s, 13)
    for n, e in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(s[e - n : e - k + 1]))
        elif n:
            with np.errstate(over="ignore"):
                x = np.uint64(n)
                for w in h[e - n : e]:
                    x = x * _BASE + w
                out.append(common.mix(np.array([x]), 14))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
