"""Mixing sources to target weights by Sainte-Lague apportionment: DataFrame functions only.

Sources share the corpus size by weight; none gets more than `most` times its size, and what it can't take is shared again. Each source
is dealt into shards of bounded length, each shard's documents stand in a seeded order and are cut into equal blocks of about `block`
words. The highest quotients w / (2k + 1) give every source, then every shard, an integer number of blocks; whole rounds of a shard's
blocks come first, the rest is a run of blocks from a seeded start. A document takes the words that its blocks hold.

Scale. Only ids, sources and sizes are shuffled. A hot source is dealt over as many shards as its rows need. Quotients are compared only
near the final quotas (about four a source or shard), never one by one from zero.

Defined cases: null text has size 0 and takes 0; a null source is a source and comes last; a source of size 0 has target 0; an empty
table gives an empty table; repeated rows are separate documents, and rows that tie in the seeded order (equal ids) go by size; a text longer
than a block spans several and may be taken in part; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, word_count, written

WEIGHTS, MOST, BLOCK, SHARD_ROWS, SEED = (5, 2, 1), 3, 64, 4096, 17


def seeded(seed: int, *cols: str) -> Column:
    """A hash of values as text, from md5, so that any SQL engine can repeat the order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for c in cols]))


def seeded_number(seed: int, *cols: str) -> Column:
    return F.conv(F.substring(seeded(seed, *cols), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, docs, source_size, weight, target.

    Sorted by size per weight, a source is at its limit if the level that the later ones would share exceeds it.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    per = per.select("source", "docs", "source_size", given.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = per.withColumn("level", (F.col("total") - before) / rest).withColumn("full", F.col("cap") < F.col("level") * F.col("weight"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return level.select("source", "docs", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.coalesce(shared, F.lit(0.0)) * F.col("weight"))).alias("target"))


def apportion(items: DataFrame, group: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """items with quota: `seats` of each group dealt to its items by the highest quotients weight / (2k + 1), ties by key.

    With S items and T seats an item's quota lies within its share times (1 +- S / 2T), give or take a half; quotients below that
    range surely win and are counted, those in it are ranked, none above it can win.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(weight).over(whole), F.count(F.lit(1)).over(whole)
    share = F.when(total > 0, F.col(seats) * F.col(weight) / total).otherwise(0.0)
    slack = F.when(F.col(seats) > 0, n / (2 * F.col(seats))).otherwise(0.0)
    low = F.greatest(F.floor(share * (1 - slack) - 1.5), F.lit(0)).cast("long")
    high = F.ceil(share * (1 + slack) + 1.5).cast("long")
    ranged = items.withColumn("_low", low).withColumn("_high", F.when(F.col(weight) > 0, high).otherwise(low))
    ranged = ranged.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    each = ranged.select(*group, *key, "_left", F.col(weight).alias("_w"), F.explode(F.sequence("_low", "_high")).alias("_k"))
    each = each.select(*group, *key, "_left", (F.col("_w") / (2 * F.col("_k") + 1)).alias("_quotient"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), *[F.col(k).asc_nulls_last() for k in key]))
    won = each.withColumn("_rank", rank).groupBy(*group, *key).agg(F.sum((F.col("_rank") <= F.col("_left")).cast("long")).alias("_won"))
    won = won.select("_won", *[F.col(c).alias(f"_by_{c}") for c in [*group, *key]])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in [*group, *key]]
    return ranged.join(won, same, "left").select(*items.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    goal = written(targets(sizes, weights, most), "targets")
    # one row a source: broadcast while that is surely small
    small = F.broadcast(goal) if goal.count() <= 10_000 else goal
    renamed = small.select(F.col("source").alias("_source"), "docs", "source_size", "target")
    joined = sizes.join(renamed, F.col("source").eqNullSafe(F.col("_source")))
    shard: Column = F.pmod(seeded_number(seed, "doc_id"), F.ceil(F.col("docs") / shard_rows))
    rows = joined.select("doc_id", "source", "size", "source_size", "target", shard.alias("shard"))
    cells = rows.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("cell_size"))
    cells = cells.withColumn("blocks", F.when(F.col("cell_size") > 0, F.greatest(F.round(F.col("cell_size") / block), F.lit(1))).otherwise(0).cast("long"))
    cells = written(cells, "cells")
    by_source = cells.groupBy("source", "source_size", "target").agg(F.sum("blocks").alias("source_blocks"))
    wish = F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(0.0)
    by_source = by_source.withColumn("wish", wish).withColumn("seats", F.round(F.sum("wish").over(Window.partitionBy())).cast("long")).withColumn("all", F.lit(0))
    quotas = apportion(by_source, ["all"], ["source"], "wish", "seats").select(F.col("source").alias("_source"), F.least(F.col("quota"), most * F.col("source_blocks")).alias("source_quota"))
    dealt = cells.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = apportion(dealt, ["source"], ["shard"], "blocks", "source_quota")
    quota = F.least(F.col("quota"), most * F.col("blocks"))
    start = F.pmod(seeded_number(seed + 1, "source", "shard"), F.greatest(F.col("blocks"), F.lit(1)))
    runs = dealt.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "cell_size", "blocks", quota.alias("quota"), start.alias("start"))
    order = Window.partitionBy("source", "shard").orderBy(seeded(seed + 2, "doc_id"), "doc_id", "size")
    placed = rows.withColumn("b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("size"))
    full = placed.join(runs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    n = F.greatest(F.col("blocks"), F.lit(1))
    rest = F.pmod(F.col("quota"), n)
    edge = lambda k: F.floor(k * F.col("cell_size") / n)
    stop = F.col("start") + rest
    inside = lambda lo, hi: F.greatest(F.least(F.col("b"), hi) - F.greatest(F.col("a"), lo), F.lit(0))
    taken = F.floor(F.col("quota") / n) * F.col("size") + inside(edge(F.col("start")), edge(F.least(stop, n))) + inside(F.lit(0), edge(F.greatest(stop - n, F.lit(0))))
    return full.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, parts of a document rounded to the nearest whole; columns stay.

    Rows that share an id and a source share one number of copies, the mean of theirs.
    """
    mixed = mix(docs, **options)
    key, origin, times, copy = (fresh(docs, f"_{n}") for n in ("id", "source", "times", "copy"))
    copies = F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int")
    wanted = mixed.groupBy(F.col("doc_id").alias(key), F.col("source").alias(origin)).agg(copies.alias(times)).where(F.col(times) > 0)
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(origin)))
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
