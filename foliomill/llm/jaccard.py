"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.75 or more, and their components.

Exact, in four steps.
1. Sets. Each text gives its set's size, a digest of 128 bits (equal sets are one class) and a prefix. Shingles are ordered by (frequent,
   hash), where the frequent ones are those of many documents in a bounded sample: the order only steers cost, any order gives the same links. With n
   members, a set that is linked shares at least ceil(3n/4) of them, so of its first n - ceil(3n/4) + k members at least k are shared,
   and lie in the partner's prefix too, for whichever of the two prefixes ends first. k is n / 10.
2. Blocks. Shingles of a prefix that only one class has are dropped; the others lead to a block, named by the least class that has them. A
   class with fewer such shingles than k of its smallest possible partner has no link. Otherwise it leaves the blocks that account
   for fewer than half of that k: two linked classes still meet in one block, as each loses less than half of what they share.
3. Signature trees. The classes of a block meet in a task that builds a signature tree and descends it against itself. A block that is
   too large for one task is cut into chunks: each is compared with the block's centre, and only classes not linked to it are then
   held against all chunks, tree against tree. No pair is left out and no task grows with the block.
4. Components. Tasks return a spanning forest, not pairs; labels are spread with pointer jumping in tables of the shared folder.

Links. link_counts() compares all pairs of each block, linked already or not, chunk by chunk, and gives each document's number of links: the
other documents of its class and all those of classes linked to it. Two classes may meet in several blocks; only the one of the least
pivot they share counts the pair. A group of m linked classes takes m * m / 2 comparisons, and each text moves m / CHUNK times.

Scale. Texts are read twice and never shuffled whole: only those of classes in blocks move. Equal sets are collapsed before that, and a
task emits the prefix of a digest once. What is broadcast is bounded: frequent shingles to FREQUENT, hashes of texts in blocks to
BROADCAST_IDS, beyond which they are joined by a shuffle.

Limit. In a block of m different sets of which u aren't linked to its centre, u * m / CHUNK^2 tasks compare them: such texts share most
shingles with many others without being similar enough, and only a comparison can tell.

Defined cases: a text without words (null, empty, blank) has size 0, no links and its own id; with fewer than five words the whole
sequence is one shingle; equal rows are linked; rows that share an id are separate documents; null ids never name a component that has another
id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, without, written
from .shingles import shingle_sets
from .signature_tree import LinkCounter, SetForest

NUM, DEN, SHINGLE = 75, 100, 5
#: Documents sampled for the order of shingles, the share of them that makes a shingle frequent, and how many such are kept at most.
SAMPLE, FREQUENT_SHARE, FREQUENT = 16_384, 1 / 512, 1 << 18
#: Members and shingles of a chunk.
CHUNK, CHUNK_SHINGLES = 2048, 2_000_000
SLICE = 256


def _least(n: np.ndarray | int, num: int, den: int):
    """Members that a set of n must share to be linked."""
    return -(-num * n // den)


def _spare(n):
    """k: shared members asked of a prefix beyond the first."""
    return np.maximum(1, n // 10)


def prefix(values: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of a set's prefix that aren't frequent, and those that are."""
    n = len(values)
    often = np.zeros(n, dtype=bool)
    if n and len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        often = frequent[at] == values
    keep = n - _least(n, num, den) + int(_spare(n)) if n else 0
    rare = values[~often][:keep]
    return rare, values[often][: keep - len(rare)]


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(values.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(h & ((1 << 64) - 1)), signed(h >> 64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)))


def frequent_shingles(rows: DataFrame, n: int, k: int) -> np.ndarray:
    """Shingles of many documents, from the texts whose hash falls in one of n / SAMPLE classes; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                yield pa.RecordBatch.from_arrays([_lists(shingle_sets([t or "" for t in b.slice(i, SLICE).column(0).to_pylist()], k))], names=["s"])

    every = max(1, n // SAMPLE)
    some = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(run, "s array<long>")
    least = max(8, int(n / every * FREQUENT_SHARE))
    counts = some.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.col("n").desc(), "s").limit(FREQUENT).select("s").collect()  # bounded by FREQUENT
    return np.sort(np.array([r["s"] for r in found], dtype=np.int64).view(np.uint64))


def shingled(rows: DataFrame, frequent: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """doc_id, t and u (hashes of the text), n, d and e (digest), prefix, often of each row.

    prefix and often are as prefix() gives them; a task gives those of a digest once, none after that.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                sets = shingle_sets([t or "" for t in part.column(3).to_pylist()], k)
                ds = [digest(s) for s in sets]
                heads = []
                for d, s in zip(ds, sets):
                    heads.append((s[:0], s[:0]) if d in seen else prefix(s, shared.value, num, den))
                    seen.add(d)
                numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [d for d, _ in ds], [e for _, e in ds])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *numbers, *(_lists([h[j] for h in heads]) for j in (0, 1))], names=["doc_id", "t", "u", "n", "d", "e", "prefix", "often"])

    return rows.select("doc_id", "t", "u", "text").mapInArrow(run, "doc_id long, t long, u long, n long, d long, e long, prefix array<long>, often array<long>")


def one_set_each(sets: DataFrame) -> DataFrame:
    """sets, with a d of its own for each (d, e): of sets whose digests share only d, all but one are renamed. Most often nothing is."""
    shared = sets.where("n > 0").groupBy("d").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).where("lo <> hi").drop("hi")
    shared = written(shared, "shared-digests")
    if not shared.limit(1).count():
        return sets
    names = bounded(shared.withColumnRenamed("d", "_d"))
    own = F.when((F.col("e") == F.col("lo")) | F.col("lo").isNull(), F.col("d")).otherwise(F.xxhash64("d", "e"))
    return sets.join(names, F.col("d") == F.col("_d"), "left").withColumn("d", own).drop("_d", "lo")


def blocks(sets: DataFrame, num: int, den: int) -> DataFrame:
    """pivot, d, n, tokens: which classes must meet in which block, and how many shingles lead each there."""
    posted = sets.select(F.explode("prefix").alias("token"), "d", "n")
    whole = Window.partitionBy("token")
    shared = posted.select("token", "d", "n", F.min("d").over(whole).alias("pivot"), F.max("d").over(whole).alias("top")).where("pivot <> top").dropDuplicates(["token", "d"])
    # a frequent shingle may stand in any share of all sets: its ends are aggregated before a shuffle, and there are FREQUENT at most
    hot = written(sets.select(F.explode("often").alias("token"), "d", "n").dropDuplicates(["token", "d"]), "hot")
    ends = written(hot.groupBy("token").agg(F.min("d").alias("pivot"), F.max("d").alias("top")).where("pivot <> top"), "ends")
    shared = shared.unionByName(hot.join(F.broadcast(ends), "token").select("token", "d", "n", "pivot", "top"))
    per = shared.repartition("d").groupBy("d", "n", "pivot").agg(F.count(F.lit(1)).alias("tokens"))
    least = F.ceil(F.lit(num) * F.col("n") / den)
    need = F.greatest(F.floor(least / 10), F.lit(1))
    order = Window.partitionBy("d").orderBy("tokens", "pivot")
    ranked = per.withColumn("total", F.sum("tokens").over(Window.partitionBy("d"))).withColumn("up_to", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("total") >= need) & (F.col("up_to") > F.floor((need - 1) / 2))).select("pivot", "d", "n", "tokens")


def bounded(df: DataFrame) -> DataFrame:
    """df, broadcast if it has no more than BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def sized(rows: DataFrame, *more) -> DataFrame:
    """pivot, chunks (of at most about CHUNK members and CHUNK_SHINGLES shingles) and more aggregates; blocks of one member are left out."""
    n = F.count(F.lit(1))
    chunks = F.greatest(F.ceil(n / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    return rows.groupBy("pivot").agg(chunks.alias("chunks"), n.alias("members"), *more)


def _task(f, k: int, num: int, den: int):
    """An Arrow function over a task's rows (d, text, left, right, linked): f(forest, left, right, linked) links, the roots are returned.

    Rows of one class hold one text.
    """

    def run(table: pa.Table) -> pa.Table:
        cls = table.column("d").to_numpy()
        sets, at = shingle_sets([t or "" for t in table.column("text").to_pylist()], k), {}
        for i, c in enumerate(cls.tolist()):
            at.setdefault(c, []).append(i)
        if len(at) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        flag = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "linked")}
        # left ones come first, so that the centre of a star is the root of what it links
        at = dict(sorted(at.items(), key=lambda x: not flag["left"][x[1]].any()))
        any_of = lambda c: np.flatnonzero([flag[c][i].any() for i in at.values()])
        forest = SetForest([sets[i[0]] for i in at.values()], num, den)
        f(forest, any_of("left"), any_of("right"), any_of("linked"))
        forest.settle()
        own = np.array(list(at), dtype=np.int64)
        moved = np.flatnonzero(forest.root != np.arange(len(own)))
        return pa.table({"a": pa.array(own[moved]), "b": pa.array(own[forest.root[moved]])})

    return run


def _whole(forest: SetForest, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> None:
    forest.link(left)


def _star(forest: SetForest, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> None:
    """left is the centre alone."""
    if len(left):
        forest.compare(int(left[0]), np.setdiff1d(np.arange(forest.n), left))


def _rest(forest: SetForest, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> None:
    if len(linked):  # joined by way of the centre already
        forest.root[linked] = linked.min()
    forest.join(left)
    forest.join(left, np.setdiff1d(right, left))


def forest(members: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b: edges that connect all linked classes that meet in a block.

    A block of one chunk is a task. In a larger one every chunk is first compared with the block's centre, the class that most of its
    shingles lead there; only classes that aren't linked to it are then compared with all, chunk by chunk.
    """
    none = F.lit(False)
    flags = lambda df, left, right=none, linked=none: df.select("pivot", "i", "j", "d", "t", "u", left.alias("left"), right.alias("right"), linked.alias("linked"))
    run = lambda rows, f: rows.join(texts, ["t", "u"]).groupBy("pivot", "i", "j").applyInArrow(_task(f, k, num, den), "a long, b long")
    sizes = written(sized(members, F.max_by("d", F.struct("tokens", "d")).alias("centre")).where("members > 1"), "sizes")
    placed = written(members.join(bounded(sizes), "pivot"), "members")
    small = placed.where("chunks = 1").withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    edges = run(flags(small, F.lit(True)), _whole)
    big = placed.where("chunks > 1").withColumn("own", F.pmod(F.xxhash64("d"), F.col("chunks")).cast("int"))
    if not big.limit(1).count():
        return edges
    centres = big.where("d = centre").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    stars = flags(centres.withColumn("j", F.lit(0)), F.lit(True)).unionByName(flags(big.where("d <> centre").withColumn("i", F.col("own")).withColumn("j", F.lit(0)), none))
    found = written(run(stars, _star), "stars")
    # an edge of a star joins its two ends, one of them the centre
    ends = found.select(F.explode(F.array("a", "b")).alias("d"), F.array("a", "b").alias("ab"))
    linked = written(big.join(ends, "d").where(F.array_contains("ab", F.col("centre"))).select("pivot", "d").distinct(), "linked")
    left = written(big.where("d <> centre").join(linked, ["pivot", "d"], "left_anti"), "left")
    lefts = bounded(written(sized(left).select("pivot", F.col("chunks").alias("parts")), "parts"))
    rest_left = left.join(lefts, "pivot").withColumn("i", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    marked = big.join(linked.withColumn("by_star", F.lit(True)), ["pivot", "d"], "left").withColumn("is_linked", F.coalesce("by_star", F.lit(False)) | (F.col("d") == F.col("centre")))
    rest_right = marked.join(lefts, "pivot").withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = run(flags(rest_left, F.lit(True)).unionByName(flags(rest_right, none, F.lit(True), F.col("is_linked"))), _rest)
    return edges.unionByName(found).unionByName(rest)


def _count_task(k: int, num: int, den: int):
    """An Arrow function over rows (d, text, size, lesser, left, right): edges (a, b) of a spanning forest, and (a, null, n): a has n links here."""

    def run(table: pa.Table) -> pa.Table:
        cls = table.column("d").to_numpy()
        sets, at = shingle_sets([t or "" for t in table.column("text").to_pylist()], k), {}
        for i, c in enumerate(cls.tolist()):
            at.setdefault(c, i)
        own, rows = np.array(list(at), dtype=np.int64), np.array(list(at.values()), dtype=np.int64)
        if len(own) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        lesser = table.column("lesser").to_pylist()
        forest = LinkCounter([sets[i] for i in rows], num, den, table.column("size").to_numpy()[rows], [np.array(lesser[i], dtype=np.int64) for i in rows])
        left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)[rows]) for c in ("left", "right"))
        forest.join(left, None if len(left) == len(own) else right)
        forest.merge()
        moved, has = np.flatnonzero(forest.root != np.arange(len(own))), np.flatnonzero(forest.links)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({"a": np.concatenate([own[moved], own[has]]), "b": pa.chunked_array([pa.array(own[forest.root[moved]]), none(len(has))]), "n": pa.chunked_array([none(len(moved)), pa.array(forest.links[has])])})

    return run


def counted(members: DataFrame, texts: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b, n: edges that connect all linked classes (n null), and parts n of the number of documents in classes linked to a (b null)."""
    sizes = written(sized(members).where("members > 1"), "sizes")
    before = Window.partitionBy("d").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)
    placed = members.withColumn("lesser", F.collect_list("pivot").over(before)).join(bounded(sizes), "pivot").join(classes.select("d", "size"), "d")
    own = F.pmod(F.xxhash64("d"), F.col("chunks")).cast("int")
    # each pair of chunks is a task, also a chunk with itself
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = pairs.select("pivot", "i", "j", "d", "t", "u", "size", "lesser", (F.col("own") == F.col("i")).alias("left"), (F.col("own") == F.col("j")).alias("right"))
    return rows.join(texts, ["t", "u"]).groupBy("pivot", "i", "j").applyInArrow(_count_task(k, num, den), "a long, b long, n long")


def components(edges: DataFrame) -> DataFrame:
    """v, c: for every vertex of edges (a, b) the least vertex it is connected with.

    Each round takes the least label of the neighbours, then the label of that label; tables are written to the shared folder.
    """
    both = written(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).where("v <> u").distinct(), "edges")
    labels = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").groupBy("v").agg(F.min("cu").alias("cu"))
        step = labels.join(near, "v").select("v", "c", F.least("c", "cu").alias("s"))
        jump = labels.select(F.col("v").alias("s"), F.col("c").alias("cs"))
        after = written(step.join(jump, "s", "left").select("v", F.col("c").alias("was"), F.coalesce(F.least("s", "cs"), "s").alias("c")), "labels")
        if not after.where("c <> was").limit(1).count():
            return after.select("v", "c")
        labels = after.select("v", "c")


def _meeting(docs: DataFrame, num: int, den: int, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sets, classes, members of blocks and texts of those, as tables."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.xxhash64(F.lit("u"), text_col).alias("u"), F.col(text_col).alias("text"))
    frequent = frequent_shingles(rows, rows.count(), k)
    sets = one_set_each(written(shingled(rows, frequent, k, num, den), "sets"))
    classes = written(sets.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("rep"), F.min("t").alias("t"), F.min_by("u", "t").alias("u"), F.count(F.lit(1)).alias("size")), "classes")
    members = written(written(blocks(sets, num, den), "blocks").join(classes.select("d", "t", "u"), "d"), "meeting")
    # one text of each pair of hashes; equal ones are merged in their tasks before they move
    texts = written(rows.select("t", "u", "text").join(bounded(members.select("t", "u").distinct()), ["t", "u"], "left_semi").groupBy("t", "u").agg(F.min("text").alias("text")), "texts")
    return sets, classes, members, texts


def _named(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """d, component of every class."""
    reached = components(edges)
    least = classes.join(reached, classes["d"] == reached["v"]).groupBy("c").agg(F.min("rep").alias("least"))
    linked = reached.join(least, "c").select(F.col("v").alias("d"), "least")
    return classes.join(linked, "d", "left").select("d", F.coalesce("least", "rep").alias("component"))


_ALONE = "case when n = 0 then doc_id else coalesce(component, doc_id) end as component_id"


def similar_components(docs: DataFrame, num: int = NUM, den: int = DEN, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest id that it reaches by links."""
    sets, classes, members, texts = _meeting(docs, num, den, k, id_col, text_col)
    names = written(_named(classes, written(forest(members, texts, k, num, den), "forest")), "names")
    return sets.select("doc_id", "n", "d").join(names, "d", "left").selectExpr("doc_id", "n as n_shingles", _ALONE)


def link_counts(docs: DataFrame, num: int = NUM, den: int = DEN, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document: how many other rows are similar enough to it."""
    sets, classes, members, texts = _meeting(docs, num, den, k, id_col, text_col)
    found = written(counted(members, texts, classes, k, num, den), "counted")
    per = found.where("n is not null").groupBy(F.col("a").alias("d")).agg(F.sum("n").alias("linked"))
    names = _named(classes, found.where("n is null").select("a", "b"))
    links = classes.select("d", "size").join(per, "d", "left").select("d", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    whole = written(names.join(links, "d"), "names")
    return sets.select("doc_id", "n", "d").join(whole, "d", "left").selectExpr("doc_id", "n as n_shingles", _ALONE, "case when n = 0 then 0L else links end as n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose id isn't the one that names their component.

    All rows of an id that names a component stay, and so do rows whose id is null: they can't be told apart by id.
    """
    found = similar_components(docs, **options)
    return without(docs, found.where("component_id <> doc_id").select("doc_id").distinct())
