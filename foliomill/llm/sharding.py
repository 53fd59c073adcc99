"""Sharding by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own (an offset and a step hashed from its name); shards take turns and
claim their next free slot, a shard of weight w being given w turns a round, until the table is full. A key's hash picks a slot and so
its shard: one lookup, even shares, and few keys move when a shard comes or goes.

Two shards that want one slot: the one whose turn comes first has it, turns going by name. Keys may be texts of any length.

Defined cases: a null key has a slot of its own hash like any key; equal keys share a shard, unless spread_by names columns that deal the
rows of hot keys over `spread` places; an empty table gives an empty table; only key columns and the result are returned.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prime; a shard's share is even to about 1 % with a hundred slots a shard.
TABLE_SIZE = 65_537
#: The broadcast table has one row a slot, so this bounds it to about 16 MB.
LARGEST_TABLE = 1_048_573


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def build_table(shards: dict[str, int], size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot. shards: weight (1 or more turns a round) by name; the order of names doesn't matter."""
    if not _is_prime(size) or size > LARGEST_TABLE:
        raise ValueError(f"size must be a prime up to {LARGEST_TABLE}")
    if not shards or len(shards) > size or min(shards.values()) < 1:
        raise ValueError("there must be 1 to `size` shards, of weight 1 or more")
    names = sorted(shards)
    step = [xxhash.xxh64_intdigest(n, seed=2) % (size - 1) + 1 for n in names]
    at = [xxhash.xxh64_intdigest(n, seed=1) % size for n in names]
    slots, left = [-1] * size, size
    while left:
        for i, name in enumerate(names):
            for _ in range(min(shards[name], left)):
                while slots[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                slots[at[i]] = i
                left -= 1
    return [names[i] for i in slots]


def place(df: DataFrame, keys: list[str], table: list[str], spread_by: list[str] | None = None, spread: int = 1) -> DataFrame:
    """keys, slot, shard of every row. The table is broadcast: its length is checked when it is built."""
    if len(table) > LARGEST_TABLE:
        raise ValueError("the table is too long to broadcast")
    salt = [F.pmod(F.xxhash64(*spread_by), F.lit(spread))] if spread_by and spread > 1 else []
    lookup = df.sparkSession.createDataFrame(list(enumerate(table)), "slot long, shard string")
    keyed = df.select(*keys, F.pmod(F.xxhash64(*keys, *salt), F.lit(len(table))).alias("slot"))
    return keyed.join(F.broadcast(lookup), "slot").select(*keys, "slot", "shard")
