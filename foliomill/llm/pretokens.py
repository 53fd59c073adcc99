"""Encoding texts by their pre-tokens, with bounded caches of what was resolved before.

The pattern starts a new match at every single space between non-blank characters, so a text may be cut there and each piece encoded for
itself. A batch's pieces are made distinct first, so that each is looked up once; what was resolved in earlier batches is found by hash
and confirmed by its bytes. A text in which a space touches another blank, or stands at an end, takes the plain path: all matches of
the pattern.

Defined cases: a null text is empty and has no ids; a text longer than AT_ONCE is a slice of its own and is encoded whole; repeated rows
have equal ids; no texts give no ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .hashing import chunk_hashes

#: Bytes of text that are encoded at once.
AT_ONCE = 4 << 20


#: Bytes of pieces that are remembered at most.
MOST_BYTES = 64 << 20


def raw_pieces(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each one's begin (one entry more than strings)."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


class _Known:
    """Ids of pieces seen before: found by hash in sorted arrays, the newest entries apart until there are many, and confirmed byte by byte.

    Bounded by `limit` entries. Of two pieces with one hash the second is not found, and is resolved anew each time.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.parts = [self._empty(), self._empty()]
        self.pool, self.used = np.empty(1 << 16, dtype="<u4"), 0
        self.raw, self.raw_used = np.empty(1 << 18, dtype=np.uint8), 0

    @staticmethod
    def _empty() -> list[np.ndarray]:
        """hash, place and number of ids in the pool, place and number of bytes in raw."""
        return [np.empty(0, np.uint64), *(np.empty(0, np.int32) for _ in range(4))]

    @staticmethod
    def _grown(pool: np.ndarray, used: int, new: np.ndarray, spare: int) -> np.ndarray:
        if used + len(new) > len(pool):
            pool = np.concatenate([pool[:used], np.empty(len(new) + spare, dtype=pool.dtype)])
        pool[used : used + len(new)] = new
        return pool

    def find(self, h: np.ndarray, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each one's ids begin in the pool (-1 if unknown), and how many they are; piece i has the bytes raw[at[i] : at[i + 1]]."""
        off, n = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        size = np.diff(at)
        for k, o, m, place, length in self.parts:
            if not len(k):
                continue
            i = np.minimum(np.searchsorted(k, h), len(k) - 1)
            hit = np.flatnonzero((k[i] == h) & (length[i] == size) & (off < 0))
            if not len(hit):
                continue
            j, long = i[hit], size[hit]
            starts = np.cumsum(long) - long
            step = np.arange(int(long.sum()))
            unlike = raw[np.repeat(at[hit] - starts, long) + step] != self.raw[np.repeat(place[j] - starts, long) + step]
            same = np.ones(len(hit), dtype=bool)
            if unlike.any():
                same[np.searchsorted(starts, np.flatnonzero(unlike), side="right") - 1] = False
            off[hit[same]], n[hit[same]] = o[j[same]], m[j[same]]
        return off, n

    def add(self, h: np.ndarray, pieces: list[bytes], ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keeps new pieces with their ids; returns where those begin in the pool and how many they are."""
        n = np.array([len(x) >> 2 for x in ids], dtype=np.int64)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        off = self.used + np.cumsum(n) - n
        self.pool = self._grown(self.pool, self.used, flat, 1 << 20)
        size, text = np.array([len(x) for x in pieces], dtype=np.int64), np.frombuffer(b"".join(pieces), dtype=np.uint8)
        place = self.raw_used + np.cumsum(size) - size
        self.raw = self._grown(self.raw, self.raw_used, text, 1 << 22)
        self.used, self.raw_used = self.used + len(flat), self.raw_used + len(text)
        self.parts[1] = self._merged(self.parts[1], [h, *(x.astype(np.int32) for x in (off, n, place, size))])
        if len(self.parts[1][0]) > 250_000:
            self.parts = [self._merged(*self.parts), self._empty()]
        return off, n

    @staticmethod
    def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        both = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        return [x[order] for x in both]

    def turn(self) -> None:
        if len(self.parts[0][0]) + len(self.parts[1][0]) > self.limit or self.raw_used > MOST_BYTES:
            self.clear()


class _Cache(dict):
    """At most about `limit` resolved entries; emptied when full."""

    def __init__(self, resolve, limit: int):
        super().__init__()
        self.resolve, self.limit = resolve, limit

    def __missing__(self, key):
        self[key] = found = self.resolve(key)
        return found

    def turn(self) -> None:
        if len(self) > self.limit:
            self.clear()


class PretokenEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    resolve(pre_token) gives the bytes of one match's ids. Equal results whatever the caches hold.
    """

    def __init__(self, pattern: str, resolve, limit: int = 1_000_000, stand_ins: dict[int, str] | None = None):
        """stand_ins: for code points that another library's tables class differently, a code point of the class they have there."""
        self._matches, self._stand_ins = regex.compile(pattern), stand_ins or {}
        self._odd = regex.compile("[" + "".join(f"\\U{c:08X}" for c in self._stand_ins) + "]") if stand_ins else None
        self._one = _Cache(resolve, 100_000)
        self._resolve, self._known = resolve, _Known(limit)

    def _find(self, text: str) -> list[str]:
        if self._odd and not text.isascii() and self._odd.search(text):
            return [text[m.start() : m.end()] for m in self._matches.finditer(text.translate(self._stand_ins))]
        return self._matches.findall(text)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self._one.__getitem__, self._find(text)))

    def _piece(self, piece: str) -> bytes:
        """The ids of a space and the piece behind it."""
        if piece.isalpha():
            return self._resolve(" " + piece)
        if piece[-1:] in ".,;:" and piece[:-1].isalpha():
            return self._one[" " + piece[:-1]] + self._one[piece[-1]]
        return self.plain(" " + piece)

    def encode_many(self, texts: pa.StringArray, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by tail, and where each text's begin (one entry more than texts)."""
        if not len(texts):
            return np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        at -= at[0]
        blank = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(pieces), pieces), pc.equal(pc.binary_length(pieces), 0))
        plain = np.logical_or.reduceat(blank.to_numpy(zero_copy_only=False)[code], at[:-1])
        own = [self.plain(texts[i].as_py() if whole else pieces[k].as_py()) for i, (k, whole) in enumerate(zip(code[at[:-1]].tolist(), plain.tolist()))]
        raw, edges = raw_pieces(pieces)
        h = chunk_hashes(raw, edges)
        off, n = self._known.find(h, raw, edges)
        new = np.flatnonzero(off < 0)
        if len(new):
            fresh = pieces.take(pa.array(new)).to_pylist()
            off[new], n[new] = self._known.add(h[new], [p.encode() for p in fresh], [self._piece(p) for p in fresh])
        # behind the pool of known pieces stand the texts' first pieces (or whole texts) and the tail
        extra = [*own, tail]
        m = np.array([len(x) >> 2 for x in extra], dtype=np.int64)
        pool = np.concatenate([self._known.pool[: self._known.used], np.frombuffer(b"".join(extra), dtype="<u4")])
        off, n = np.concatenate([off, self._known.used + np.cumsum(m) - m]), np.concatenate([n, m])
        keep = np.repeat(~plain, np.diff(at))
        keep[at[:-1]] = True
        code[at[:-1]] = len(pieces) + np.arange(len(own))
        ends = np.cumsum(np.where(plain, 1, np.diff(at)))
        code = np.insert(code[keep], ends, len(n) - 1)
        long = n[code]
        stop = np.cumsum(long)
        index = np.repeat((off[code] - (stop - long)).astype(np.int32), long)
        index += np.arange(len(index), dtype=np.int32)
        self._one.turn()
        self._known.turn()
        del lists, coded, pieces, code, long
        pa.default_memory_pool().release_unused()
        return pool[index], np.concatenate([[0], stop[ends + np.arange(len(ends))]])

    def encode(self, text: str) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()


def slices(batch: pa.RecordBatch, column: int) -> list[pa.RecordBatch]:
    """The batch cut so that no part has much more than AT_ONCE bytes of text; null texts become empty ones."""
    texts = pc.fill_null(batch.column(column).cast(pa.string()), "")
    batch = pa.RecordBatch.from_arrays([texts if i == column else x for i, x in enumerate(batch.columns)], names=batch.schema.names)
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    out, start = [], 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + AT_ONCE, side="right")))
        out.append(batch.slice(start, stop - start))
        start = stop
    return out
