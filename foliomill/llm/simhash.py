"""Document fingerprints by SimHash: DataFrame functions only.

A text's terms are its lower-cased runs of five words (all words, where there are fewer); a term's weight is its count. Each term's 64-bit
hash votes with its weight for or against every bit, and the sign of the sum is the bit. Fingerprints within a Hamming radius r are found
with permuted block tables: of b blocks at least b - r agree, so each choice of b - r blocks is a table keyed by those bits.

near_counts() counts for every document the others within the radius: documents of one fingerprint are a class, only classes are compared.

Scale. Two bits' votes share one long counter, so 32 sums serve 64 bits and partial sums never leave a task. The edited-text query deals
documents by ranges of their id into small buckets; a bucket also gets a copy of the first row of the next one, so that one exchange of
the text serves the order, the edit, both fingerprints and the comparison.

Defined cases: a null text is empty; a text without words has the fingerprint 0; equal texts have equal fingerprints; an empty table gives
an empty table; null ids sort last in descending order; rows that share an id are ordered by a hash of their text; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, words, written
from .quality import bound

TERM_WORDS = 5
#: Rows of a range bucket, and the most buckets: their boundaries are constants of the plan.
BUCKET_ROWS, MOST_BUCKETS, COARSE = 256, 65_536, 64
#: Blocks of the permuted tables; a key with more than HOT_KEY fingerprints is split by tables over the next, finer blocks.
RADIUS, BLOCKS, HOT_KEY = 3, (6, 8, 16), 256


def term_hashes(text: Column) -> Column:
    """The hashes of a text's terms, one for each occurrence."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - TERM_WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(TERM_WORDS)]))
        few = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.concat_ws(" ", w))))
        return F.when(F.size(w) < TERM_WORDS, few).otherwise(each)

    return bound(words(F.lower(text)), of)


#: Bits k and k + 32 of a hash, each in the low bit of a half.
_HALVES = 0x0000000100000001


def vote_sums(h: Column) -> list[Column]:
    """Aggregates over exploded hashes: votes for bits k and k + 32 in one long, and the number of votes."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_HALVES))).alias(f"v{k}") for k in range(32)] + [F.count(h).alias("votes")]


def sign_bits() -> Column:
    """The fingerprint as a long, from what vote_sums() made. A tie leaves the bit 0."""
    out = F.lit(0).cast("long")
    for k in range(32):
        v = F.coalesce(F.col(f"v{k}"), F.lit(0).cast("long"))
        low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
        for ones, bit in ((low, k), (high, k + 32)):
            mask = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(2 * ones > F.col("votes"), F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) of every distinct id and text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_tie"), F.explode_outer(term_hashes(F.col(text_col))).alias("h"))
    return rows.groupBy("doc_id", "_tie").agg(*vote_sums(F.col("h"))).select("doc_id", sign_bits().alias("fp"))


def _bounds(docs: DataFrame, id_col: str) -> list[int]:
    """Ids that part the rows into ranges of about BUCKET_ROWS; one small aggregate over the id column."""
    n = docs.count()
    parts = min(MOST_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    if parts == 1:
        return []
    at = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / parts for k in range(1, parts)], max(10_000, 4 * parts))).first()[0]
    return sorted(set(at or []))


def _bucket(x: Column, bounds: list[int]) -> Column:
    """How many bounds are at most x, found in two steps of about COARSE comparisons; -1 for null."""
    if not bounds:
        return F.when(x.isNull(), -1).otherwise(0)
    longs = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>")
    coarse, fine = longs(bounds[COARSE - 1 :: COARSE] or [bounds[-1]]), longs(bounds)
    if len(bounds) < COARSE:
        return F.when(x.isNull(), -1).otherwise(F.size(F.filter(fine, lambda b: b <= x)))
    skipped = lambda c: c * COARSE + F.size(F.filter(F.slice(fine, c * COARSE + 1, COARSE), lambda b: b <= x))
    return F.when(x.isNull(), -1).otherwise(bound(F.size(F.filter(coarse, lambda b: b <= x)), skipped))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last third (rounded down) replaced by as many of the first characters of the next document, in descending
    order of id; the last document's next is the first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = _bounds(docs, id_col)
    heads = rows.select("doc_id", _bucket(F.col("doc_id"), bounds).alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()  # one row a bucket
    # the first row of a bucket, in descending order, follows the last row of the bucket above
    above = {(r["head"],): heads[(k + 1) % len(heads)]["bucket"] for k, r in enumerate(heads)}
    spark = docs.sparkSession
    copies = spark.createDataFrame([(h, b) for (h,), b in above.items()], "head long, copy_to int")
    dealt = rows.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(_bucket(F.col("doc_id"), bounds).cast("int").alias("bucket"), F.lit(0).alias("ghost"))
    ghost = F.when(F.col("copy_to").isNotNull(), F.struct(F.col("copy_to").alias("bucket"), F.lit(1).alias("ghost")))
    dealt = dealt.select("doc_id", "text", F.explode(F.array_compact(F.array(own, ghost))).alias("at")).select("doc_id", "text", "at.bucket", "at.ghost", F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "tie")
    paired = dealt.select("bucket", "doc_id", "text", "ghost", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), k))
    both = paired.select("bucket", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), edited.alias("t")))).alias("x"))
    both = both.where("ghost = 0 or x.kind = 0")
    hashed = both.select("bucket", "rn", "ghost", "doc_id", "n_chars", F.col("x.kind").alias("kind"), F.when(F.col("x.kind") == 1, F.sha2("x.t", 256)).alias("sha"), term_hashes(F.col("x.t")).alias("hs"))
    voted = hashed.select("bucket", "rn", "ghost", "doc_id", "n_chars", "kind", "sha", F.explode_outer("hs").alias("h")).groupBy("bucket", "rn", "ghost", "doc_id", "n_chars", "kind", "sha").agg(*vote_sums(F.col("h")))
    prints = voted.select("bucket", "rn", "ghost", "doc_id", "n_chars", "kind", "sha", sign_bits().alias("fp"))
    near = Window.partitionBy("bucket").orderBy("rn", "kind")
    # by place: a document's text, its edited text, then the next document's text
    ahead = prints.select("*", F.lead("fp", 1).over(near).alias("edited_fp"), F.lead("sha", 1).over(near).alias("edited_sha256"), F.lead("fp", 2).over(near).alias("next_fp")).where("ghost = 0 and kind = 0")
    return ahead.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def _mask(blocks: int, chosen: tuple[int, ...]) -> int:
    """The bits of the chosen blocks, of `blocks` nearly equal ones, as a signed long."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
    return bits - (1 << 64) if bits >> 63 else bits


def within_radius(prints: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS, hot: int = HOT_KEY) -> DataFrame:
    """a, b, distance: all pairs of different fingerprints (a < b) at most radius bits apart, each once; prints has a long column fp.

    Equal fingerprints are one row first, so copies never make pairs. Of the tables in which two agree only the first counts: the one of
    the first blocks that agree. A key that many fingerprints share is split by finer tables before it is joined with itself; at the
    last level a key leaves 12 bits open, so at most 4096 fingerprints meet.
    """
    rows = written(prints.select("fp").where("fp is not null").distinct(), "prints")
    keys: list[str] = []
    found = None
    for depth, count in enumerate(blocks):
        chosen = list(combinations(range(count), count - radius))
        t, key = f"t{count}", f"key{count}"
        masks = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(count, c)).cast("long")).alias("key")) for i, c in enumerate(chosen)])
        rows = rows.select("fp", *keys, F.explode(masks).alias("x")).select("fp", *keys, F.col("x.t").alias(t), F.col("x.key").alias(key))
        keys = [*keys, t, key]
        last = depth == len(blocks) - 1
        sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        marked = rows.join(sized, keys)
        marked = marked if last else written(marked, "keys")
        few = marked if last else marked.where(F.col("n") <= hot)
        left, right = few.select(F.col("fp").alias("a"), *keys), few.select(F.col("fp").alias("b"), *keys)
        differ = F.col("a").bitwiseXOR(F.col("b"))
        pairs = left.join(right, keys).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius))
        # at each level the table is that of the first agreeing blocks: those passed over differ
        for level in blocks[: depth + 1]:
            passed = [[_mask(level, (k,)) for k in range(max(c)) if k not in c] for c in combinations(range(level), level - radius)]
            skipped = F.get(F.from_json(F.lit(json.dumps(passed)), "array<array<bigint>>"), F.col(f"t{level}"))
            pairs = pairs.where(F.forall(skipped, lambda m: differ.bitwiseAND(m) != 0))
        pairs = pairs.select("a", "b", F.bit_count(differ).alias("distance"))
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        rows = marked.where(F.col("n") > hot).select("fp", *keys)
        if not rows.limit(1).count():
            return found
    return found


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints with n_near, how many other documents have a fingerprint at most radius bits away, and near_id, the least id of those and its own.

    prints has doc_id and fingerprint (as text). Documents of one fingerprint are counted once for all; pairs are of different fingerprints.
    """
    prints = written(prints, "fingerprints")
    value = F.conv(F.col("fingerprint"), 16, -10).cast("long")
    sized = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    classes = written(sized.withColumn("fp", value), "classes")
    pairs = within_radius(classes, radius)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("fp").alias("b"), "n", "least"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"), F.min("least").alias("other_least"))
    near = classes.join(others, "fp", "left").where("n > 1 or others > 0").select(F.col("fingerprint").alias("_fingerprint"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.least("least", "other_least").alias("group_least"))
    near = written(near, "near")
    if near.count() <= BROADCAST_IDS:
        near = F.broadcast(near)
    joined = prints.join(near, F.col("fingerprint") == F.col("_fingerprint"), "left")
    return joined.select(*prints.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("group_least", "doc_id").alias("near_id"))
