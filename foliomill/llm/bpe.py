"""Byte-level BPE in two tiers: a minimal perfect hash finds whole pre-tokens, the rest are merged with a heap over linked bytes.

Tier one. Every token of the vocabulary has its own slot of a table as long as the vocabulary; a displacement per bucket, found once on
the driver, leads to it, and the stored bytes confirm the match. Tier two. A pre-token that is no token becomes a doubly linked list
of its bytes; a heap holds the ranks of neighbouring pairs, stale entries are passed over, and the lowest rank (leftmost at a tie)
is merged until none is left.

Letters, digits and blanks are those of tiktoken's tables: code points that it classes otherwise are found once on the driver, and stand-ins
take their place while a text is split.

Defined cases: a null or empty text has no ids and decodes to no bytes; ids keep the order of the text; repeated rows are encoded alike, and
rows that share an id are all kept; a text of any length is encoded whole; an empty table gives an empty table; other columns are left behind,
but by with_tokens(), where columns of its names give way.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .pretokens import PretokenEncoder, slices

_CODERS: dict = {}
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"{path}: ranks have gaps")
    return tokens


#: A letter, a digit, a blank and a mark that every version of the tables classes alike and no contraction holds.
STAND_INS = {r"\p{L}": "\u0100", r"\p{N}": "\u00b2", r"\s": "\u2003", "": "\ufffc"}


@functools.lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """For each code point that tiktoken's tables class otherwise than those used here, one of the class it has there."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    out: dict[int, str] = {}
    seen: set[str] = set()
    wrong: set[str] = set()
    for kind, stand_in in STAND_INS.items():
        if not kind:
            break
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(kind, every))
        wrong |= theirs ^ ours
        out |= {ord(c): stand_in for c in theirs - ours}
        seen |= theirs
    return out | {ord(c): STAND_INS[""] for c in wrong - seen}


def _slot(h: int, shift: int, n: int) -> int:
    x = (h + shift * 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 29)) % n


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: find(key) is its index, or -1 for any other string."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        if len(set(keys)) != n:
            raise ValueError("keys must be distinct")
        buckets: list[list[int]] = [[] for _ in range(n)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % n].append(i)
        self.shift, self.at = [0] * n, [-1] * n
        for b in sorted((b for b in range(n) if len(buckets[b]) > 1), key=lambda b: -len(buckets[b])):
            shift = 1
            while True:
                slots = [_slot(hashes[i], shift, n) for i in buckets[b]]
                if len(set(slots)) == len(slots) and all(self.at[s] < 0 for s in slots):
                    break
                shift += 1
            self.shift[b] = shift
            for i, s in zip(buckets[b], slots):
                self.at[s] = i
        free = (s for s in range(n) if self.at[s] < 0)
        for b in range(n):
            if len(buckets[b]) == 1:  # a lone key is given a free slot outright
                s = next(free)
                self.shift[b], self.at[s] = -s - 1, buckets[b][0]
        self.keys, self.n = keys, n

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.n]
        i = self.at[-shift - 1 if shift < 0 else _slot(h, shift, self.n)]
        return i if i >= 0 and self.keys[i] == key else -1


class TwoTierBPE:
    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str, classes: dict[int, str] | None = None):
        """classes: as stand_ins() gives them, taken from there by default."""
        self.tokens, self.table = tokens, table
        rank = {t: i for i, t in enumerate(tokens)}
        self._byte = [rank[bytes([b])] for b in range(256)]
        self._pair = {(rank[t[:k]], rank[t[k:]]): i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
        self.encoder = PretokenEncoder(pattern, self._resolve, stand_ins=stand_ins() if classes is None else classes)
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self._len, self._off = lengths, np.cumsum(lengths) - lengths
        self._all = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of a pre-token that is not a token itself."""
        ids, pair = [self._byte[b] for b in raw], self._pair
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := pair.get((ids[k], ids[k + 1]))) is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or pair.get((ids[k], ids[j])) != r:
                continue  # one of the two has been merged since
            ids[k], ids[j] = r, -1
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if (s := pair.get((r, ids[m]))) is not None:
                    heappush(heap, (s, k))
            if (p := before[k]) >= 0 and (s := pair.get((ids[p], r))) is not None:
                heappush(heap, (s, p))
        return [i for i in ids if i >= 0]

    def _resolve(self, token: str) -> bytes:
        raw = token.encode()
        i = self.table.find(raw)
        return array("I", [i] if i >= 0 else self.merge(raw)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, by one gather from the vocabulary's joined bytes."""
        n = self._len[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self._all[np.arange(ends[-1]) + np.repeat(self._off[ids] - (ends - n), n)].tobytes()


def as_lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _coder(docs: DataFrame, ranks_path: str, pattern: str):
    """Broadcasts the vocabulary with its perfect hash (as large as the rank file, whatever the corpus)."""
    tokens = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens), stand_ins()))
    name = (hashlib.sha256(b"\0".join(tokens)).hexdigest(), pattern)

    def make() -> TwoTierBPE:
        """A worker process keeps its coder and caches from task to task."""
        if name not in _CODERS:
            _CODERS.clear()
            _CODERS[name] = TwoTierBPE(*shared.value[:2], pattern, shared.value[2])
        return _CODERS[name]

    return make


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (array<int>) of every document."""
    make = _coder(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), as_lists(*coder.encoder.encode_many(part.column(1)))], names=["doc_id", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tokens array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, raw (binary) of a table as encode() returns it; null tokens decode to no bytes."""
    make = _coder(tokens, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            raw = [coder.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, raw binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes the ids decode to)."""
    make = _coder(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        decimal = [str(i) for i in range(len(coder.tokens))].__getitem__
        for batch in batches:
            for part in slices(batch, 1):
                all_ids, at = coder.encoder.encode_many(part.column(1))
                ids_sha, raw_sha = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    ids = all_ids[a:b]
                    ids_sha.append(hashlib.sha256(",".join(map(decimal, ids.tolist())).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with the columns tokens (array<int>), n_tokens and round_trip: whether the ids decode to the text's bytes.

    Columns of those names in docs give way to the new ones; a null text has no tokens and decodes to an empty one.
    """
    make, schema = _coder(docs, ranks_path, pattern), docs.drop("tokens", "n_tokens", "round_trip").schema
    at = docs.columns.index(text_col)
    keep = [docs.columns.index(c) for c in schema.names]
    out = schema.add("tokens", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at)
                ids, starts = coder.encoder.encode_many(texts)
                same = pa.array([coder.decode(ids[a:b]) == t.encode() for a, b, t in zip(starts[:-1].tolist(), starts[1:].tolist(), texts.to_pylist())], pa.bool_())
                # texts that were null stay null, though they are encoded as empty
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], as_lists(ids, starts), pa.array(np.diff(starts)), same], names=out.names)

    return docs.mapInArrow(run, out)
