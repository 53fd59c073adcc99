from collections import Counter

import pytest

from foliomill.llm import sharding


def test_table_is_full_even_and_stable():
    shards = {f"s{i}": 1 for i in range(50)}
    table = sharding.build_table(shards, 10_007)
    n = Counter(table)
    assert sum(n.values()) == 10_007 and max(n.values()) - min(n.values()) <= 1
    fewer = sharding.build_table({k: 1 for k in shards if k != "s7"}, 10_007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != "s7")
    assert moved < 0.15 * 10_007
    assert table == sharding.build_table(dict(reversed(shards.items())), 10_007)


def test_table_against_a_plain_refill():
    """Each shard's whole permutation is written out; turns are taken by popping its next slot that is still free."""
    import xxhash

    shards, size = {"a": 2, "b": 1, "c": 3}, 211
    orders = {n: [(xxhash.xxh64(n, seed=1).intdigest() + k * (xxhash.xxh64(n, seed=2).intdigest() % (size - 1) + 1)) % size for k in range(size)] for n in shards}
    assert all(sorted(o) == list(range(size)) for o in orders.values())
    owner = {}
    while len(owner) < size:
        for n in sorted(shards):
            for _ in range(shards[n]):
                free = [s for s in orders[n] if s not in owner]
                if free:
                    owner[free[0]] = n
    assert sharding.build_table(shards, size) == [owner[s] for s in range(size)]


def test_weights():
    n = Counter(sharding.build_table({"a": 3, "b": 1}, 10_007))
    assert abs(n["a"] - 3 * n["b"]) <= 4


@pytest.mark.parametrize("size,shards", [(10, {"a": 1}), (11, {}), (3, {"a": 1, "b": 1, "c": 1, "d": 1}), (11, {"a": 0})])
def test_wrong_tables_are_refused(size, shards):
    with pytest.raises(ValueError):
        sharding.build_table(shards, size)


def test_place(spark):
    df = spark.createDataFrame([(1, "x", "q"), (1, "y", "q"), (None, "z", None)], "doc_id long, slot string, shard string")
    table = sharding.build_table({"a": 1, "b": 1}, 101)
    got = sharding.place(df, ["doc_id"], table).collect()
    assert len(got) == 3 and all(r["shard"] == table[r["slot"]] for r in got)
    assert len({r["slot"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.place(df.where("false"), ["doc_id"], table).count() == 0
    keys = spark.createDataFrame([(k,) for k in range(300)], "doc_id long")
    want = {r["doc_id"]: r["h"] % 101 for r in keys.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}  # Python's % is never negative
    assert {r["doc_id"]: r["slot"] for r in sharding.place(keys, ["doc_id"], table).collect()} == want
    hot = spark.range(5000).selectExpr("1 as k", "id as row")
    assert len({r["slot"] for r in sharding.place(hot, ["k"], table, ["row"], 64).collect()}) > 30
