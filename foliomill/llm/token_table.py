"""Token ids as Parquet list columns: ordered, page-indexed files that can be read by token or by metadata alone.

Layout. One row a document, in ascending order of doc_id across and within files: shard, doc_id, start_in_shard, n_tokens and
tokens (a list of 32-bit ids). Ids are dictionary-encoded (a vocabulary is small), the number columns delta-encoded (Parquet's version 2
pages); row groups and page sizes are set, and the writer adds column and offset indexes, so a read of some documents skips pages
and a read of metadata never touches the ids.

Defined cases: a null text is an empty one; a document without tokens holds only the end id; null ids come first; rows that repeat an id
are all kept, ordered by a hash of their text; a text of any length is encoded whole; an empty table gives an empty table; other columns are
left behind.
"""

from __future__ import annotations

import contextlib
import functools
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path
from .pretokens import PretokenEncoder, slices

WRITER = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(2 << 20),
}
SCHEMA = "shard int, doc_id long, start_in_shard long, n_tokens long, tokens array<int>"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def doubtful_letters() -> str:
    """A pattern of the code points that tables of different Unicode versions may class differently as letter, digit or neither.

    Sure are those that an early version (3.2) and this one class alike, and those assigned since that are neither letters nor digits.
    """
    now, early = unicodedata.category, unicodedata.ucd_3_2_0.category
    kind = lambda c: c[0] if c[0] in "LNZ" else c if c == "Cn" else "o"
    ranges: list[list[int]] = []
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        a, b = kind(now(c := chr(i))), kind(early(c))
        if a != "Cn" and (a == b or (a == "o" and b == "Cn")):
            continue
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@functools.lru_cache(maxsize=1)
def make_encoder(json_text: str, pattern: str, doubtful: str | None = None):
    """(texts, tail) -> ids in a row and where each text's begin, as tokenizers' encode(text, add_special_tokens=False) gives them.

    The library's own model encodes each distinct pre-token. A vocabulary with a normaliser or another pre-tokenizer, texts that hold
    an added token's string, and texts with a letter whose class depends on the Unicode version (doubtful) go through the library
    whole. A worker process keeps its encoder and caches from task to task.
    """
    import json

    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(json_text)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    letters, model = byte_letters(), whole.model
    spec = json.loads(json_text)

    def by_library(text: str) -> bytes:
        return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()

    def resolve(token: str) -> bytes:
        # printable ASCII but the space stands for itself
        written_as = token.replace(" ", letters[32]) if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in model.tokenize(written_as)]).tobytes()

    own = PretokenEncoder(pattern, resolve)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("dropout"):
        marked = lambda texts: np.ones(len(texts), dtype=bool)
    else:
        doubtful = doubtful or doubtful_letters()

        def marked(texts: pa.StringArray) -> np.ndarray:
            found = [pc.match_substring(texts, a).to_numpy(zero_copy_only=False) for a in added]
            return np.logical_or.reduce([pc.match_substring_regex(texts, doubtful).to_numpy(zero_copy_only=False), *found])

    def encode(texts: pa.StringArray, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
        odd = marked(texts)
        if not odd.any():
            return own.encode_many(texts, tail)
        ids = [by_library(t) + tail if o else own.encode(t) + tail for t, o in zip(texts.to_pylist(), odd)]
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids])])

    return encode


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While plans are made inside, at most so many rows go to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **writer: str) -> None:
    """Encodes every document, appends end_id and writes the table described above to path.

    One exchange, by ranges of the id; each task encodes its rows in order and writes one file. The vocabulary file is read once
    on the driver and broadcast: its size is that of the file, whatever the corpus.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast((f.read(), doubtful_letters()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, shard, start = make_encoder(vocabulary.value[0], pattern, vocabulary.value[1]), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 1):
                ids, at = to_ids(part.column(1), tail)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), shard, dtype=np.int32)),
                        part.column(0),
                        pa.array(start + at[:-1]),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4"))),
                    ],
                    names=["shard", "doc_id", "start_in_shard", "n_tokens", "tokens"],
                )
                start += int(at[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    with small_batches(spark):
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, SCHEMA).write.options(**(WRITER | writer)).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """The table at path; columns and a range of ids reach the scan, so only their pages are read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if doc_ids:
        df = df.where(F.col("doc_id").between(*doc_ids))
    return df.select(*columns) if columns else df


def shard_offsets(spark: SparkSession, path: str) -> DataFrame:
    """shard, offset: ids before each shard. One row a file; ids aren't read."""
    totals = read_tokens(spark, path, ["shard", "start_in_shard", "n_tokens"]).groupBy("shard").agg(F.max(F.col("start_in_shard") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("offset"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read back from the files.

    The offsets that are broadcast have one row a file that was written.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            raw = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(crc, pa.int64())], names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"])

    sums = read_tokens(spark, path).mapInArrow(digest, "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long")
    return sums.join(F.broadcast(shard_offsets(spark, path)), "shard").select("doc_id", (F.col("start_in_shard") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_digest(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Writes the token table to the shared folder and returns the digests of what the files hold."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, pattern, end_id)
    return token_digests(docs.sparkSession, path)
