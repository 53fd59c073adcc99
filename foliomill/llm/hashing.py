"""Hashes of many byte strings at once, with numpy.

A string is read in chunks of eight bytes from its own start. Each chunk is mixed with a constant of its place in a way that isn't linear, and
a string's hash is the mixed sum of its chunks and its length; so no repeating or complementary pattern of bytes cancels out.

Defined cases: an empty string has a hash like any other; no strings give no hashes; memory grows with the bytes given, not with the
longest string.
"""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = mix((np.arange(512, dtype=np.uint64) + np.uint64(1)) * _GOLD)


def _places(n: int) -> np.ndarray:
    """The constants of a string's first n chunks."""
    return _PLACES if n <= len(_PLACES) else mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _GOLD)


def chunk_hashes(raw: np.ndarray, at: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each string raw[at[i] : at[i + 1]], or raw[at[i] : stop[i]] where stops are given."""
    begin, end = (at[:-1], at[1:]) if stop is None else (at, stop)
    n = end - begin
    chunks = (n + 7) >> 3
    first = np.cumsum(chunks) - chunks
    place = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
    byte = np.repeat(begin, chunks) + 8 * place
    cut = np.where(chunks > 0, 64 * chunks - 8 * n, 0).astype(np.uint64)
    last = first + chunks - 1
    # eight bytes from any place on, as one number; bytes behind the string's end are cut off
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))[byte].view("<u8").reshape(-1)
    full = np.flatnonzero(chunks)
    words[last[full]] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> cut[full]
    mixed = mix(words + _places(int(chunks.max(initial=0)))[place])
    h = n.astype(np.uint64) * _GOLD
    if len(full):
        h[full] += np.add.reduceat(mixed, first[full])
    return mix(h)
