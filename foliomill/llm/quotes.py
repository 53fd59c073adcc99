"""Quotation linking: messages to what they quote, and conversations in reply order without quotes.

A line's quote level is the number of > that lead it. Consecutive lines of one level are a passage; level 0 is the message's own text, less
a line that only announces a quote. Passages are normalised (lower case, runs of anything but letters and digits as one blank) and
hashed, whole, by paragraph, by line and by sentence. Quoted passages are joined, within a conversation, to the first message whose own text has such a
passage; the longest unit of a passage that is found names its original. A message's parent is the original of its outermost quotes that
covers most characters.

Order. A message stands in the thread of its parent, else it opens one. Conversations are ordered by thread (by its first turn), then turn,
so each reply follows its original. Threads are found by pointer jumping in tables of the shared folder; positions by a range exchange and a
count per file, so neither a conversation nor a thread has to fit one task.

Scale. Own passages are reduced to one row a conversation and hash before the join, so a line that thousands of messages share is one row
there and the other side is split where it is hot; no pairs are made.

Defined cases: null text is empty; a message without quotes, or whose quotes aren't found in an earlier turn, has no parent; nulls in
conv_id or turn are never linked and come first; rows that repeat a turn are all kept and share a parent; units of any length are linked
if they hold a letter or digit, ties going to the earliest turn; an empty table gives an empty table; other columns are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_LEAD = re.compile(r"^((?:[ \t]{0,2}>)+)[ \t]?")
# Fixed forms of a line that announces a quote.
ANNOUNCES = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*$", re.I)
_GAP = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def passages(text: str) -> list[tuple[int, str]]:
    """(level, text) of each run of lines of one level, in order; announcing lines right before a deeper quote are dropped."""
    rows: list[tuple[int, str]] = []
    for line in text.split("\n"):
        m = _LEAD.match(line)
        rows.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    out: list[tuple[int, list[str]]] = []
    for i, (level, line) in enumerate(rows):
        if ANNOUNCES.match(line):
            after = next((r for r in rows[i + 1 :] if r[0] != level or r[1].strip()), None)
            if after and after[0] > level:
                continue
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(level, "\n".join(lines)) for level, lines in out]


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def units(text: str) -> list[tuple[int, str]]:
    """(rank, normalised unit): the whole passage (0), its paragraphs (1), lines (2) and sentences (3); repeated units are left out."""
    seen, out = set(), []
    for rank, parts in enumerate(([text], re.split(r"\n\s*\n", text), text.split("\n"), _SENTENCE.split(text))):
        for p in parts:
            if (n := normal(p)) and n not in seen:
                seen.add(n)
                out.append((rank, n))
    return out


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), own (hashes of the own text's units), quotes (level, passage, rank, chars, hash)."""
    quote = pa.struct([("level", pa.int32()), ("passage", pa.int32()), ("rank", pa.int32()), ("chars", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, own, quotes = [], [], []
            for t in b.column(3).to_pylist():
                parts = passages(t or "")
                clean = re.sub(r"\n{3,}", "\n\n", "\n".join(p for level, p in parts if not level)).strip("\n")
                texts.append(clean)
                mine = {h for level, p in parts if not level for h in (_hash(u) for _, u in units(p))}
                own.append(sorted(mine | {_hash(u) for _, u in units(clean)}))
                quotes.append([{"level": level, "passage": k, "rank": rank, "chars": len(u), "hash": _hash(u)} for k, (level, p) in enumerate(parts) if level for rank, u in units(p)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array(quotes, pa.list_(quote))], names=["conv_id", "turn", "role", "text", "own", "quotes"])

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, own array<long>, quotes array<struct<level:int,passage:int,rank:int,chars:long,hash:long>>")


def quote_links(parts: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, original (turn), chars: each quoted passage that was found."""
    first = parts.select("conv_id", "turn", F.explode("own").alias("hash")).where("turn is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    first = written(first, "originals")
    asked = parts.where("turn is not null").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    found = asked.join(first, ["conv_id", "hash"]).where("original < turn")
    return found.groupBy("conv_id", "turn", "level", "passage").agg(F.min_by(F.struct("original", "chars"), F.struct("rank", -F.col("chars"), "original")).alias("x")).select("conv_id", "turn", "level", "passage", "x.original", "x.chars")


def parents(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_linked."""
    per = links.groupBy("conv_id", "turn", "level", "original").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("conv_id", "turn").agg(F.min_by("original", F.struct("level", -F.col("chars"), "original")).alias("parent_turn"), F.sum("n").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread: the first turn that each linked message leads back to."""
    at = written(links.select("conv_id", "turn", F.col("parent_turn").alias("thread")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        after = written(at.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), F.col("above").isNotNull().alias("moved")), "threads")
        if not after.where("moved").limit(1).count():
            return after.drop("moved")
        at = after.drop("moved")


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, parent_turn, thread, n_quotes, n_linked, text of every message, without quotes."""
    parts = written(parsed(messages), "messages")
    found = written(parents(quote_links(parts)), "parents")
    joined = parts.join(found, ["conv_id", "turn"], "left").join(threads(found), ["conv_id", "turn"], "left")
    n_quotes = F.size(F.array_distinct(F.transform("quotes", lambda q: q["passage"])))
    rows = joined.select("conv_id", "turn", "role", "parent_turn", F.coalesce("thread", "turn").alias("thread"), n_quotes.cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, conv, at = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            place = []
            for c in b.column(0).to_pylist():
                at = at + 1 if c == conv else 0
                conv = c
                place.append(at)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(place), pa.int32()), pa.array(place, pa.int64()), *b.columns], names=["shard", "place", *b.schema.names])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "thread", "turn")] + [F.xxhash64("role", "text").asc()]
    schema = "shard int, place long, " + ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "ordered")
    # a conversation that goes on from one file to the next: one row a file at most
    heads = placed.groupBy("shard").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id", "place")).alias("conv_id"))
    per = placed.groupBy("shard", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    on = heads.select(F.col("shard").alias("_shard"), F.col("conv_id").alias("_conv"))
    before = per.join(F.broadcast(on), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("shard") < F.col("_shard"))).groupBy("_shard", "_conv").agg(F.sum("n").alias("offset"))
    full = placed.join(F.broadcast(before), (F.col("shard") == F.col("_shard")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return full.select("conv_id", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("position"), "turn", "role", "parent_turn", "thread", "n_quotes", "n_linked", "text")
