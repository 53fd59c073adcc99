"""Sets of word shingles as sorted 64-bit hashes, computed over whole batches of texts with numpy.

Words are runs of bytes other than space and tab to carriage return, after A-Z are lower-cased. A word's hash mixes its bytes eight at a
time; a shingle's hash mixes those of its words in order. Texts are read in segments of about SEGMENT bytes cut at blanks, so memory
doesn't grow with the length of a text beyond 8 bytes a word.

Defined cases: an empty or blank text has no words and an empty set; a text of fewer words than k is one shingle; a word longer than SEGMENT
is read whole; repeated texts have equal sets; no texts give no sets.
"""

from __future__ import annotations

import numpy as np

from .hashing import chunk_hashes, mix

SEGMENT = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_PLACE = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _segment(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and first bytes' places of the words of raw, which cuts no word."""
    a = np.frombuffer(raw, dtype=np.uint8)
    full = ~_BLANK[a]
    first = np.flatnonzero(full & np.concatenate([[True], ~full[:-1]]))
    if not len(first):
        return np.empty(0, np.uint64), first
    stop = np.flatnonzero(full & np.concatenate([~full[1:], [True]])) + 1
    return chunk_hashes(a, first, stop), first


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts in a row, and where each text's begin (one entry more than texts)."""
    out, counts, held, held_docs = [], np.zeros(len(texts), dtype=np.int64), [], []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            h, first = _segment(b"\n".join(held))
            edges = np.cumsum([0, *[len(x) + 1 for x in held]])
            out.append(h)
            np.add.at(counts, held_docs, np.diff(np.searchsorted(first, edges)))
        held.clear()
        held_docs.clear()
        size = 0

    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass").lower()
        while raw:
            cut = len(raw)
            if cut > SEGMENT:  # at the next blank after SEGMENT bytes
                tail = np.flatnonzero(_BLANK[np.frombuffer(raw, dtype=np.uint8, offset=SEGMENT)])
                cut = SEGMENT + int(tail[0]) if len(tail) else cut
            held.append(raw[:cut])
            held_docs.append(i)
            size += cut
            raw = raw[cut:]
            if size >= SEGMENT:
                flush()
    flush()
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; the whole sequence as one where words are fewer, none without words."""
    w, at = word_hashes(texts)
    n = len(w)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += w[j:] * _PLACE[j]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            sets.append(mix((w[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
