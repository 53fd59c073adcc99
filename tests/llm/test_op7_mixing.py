from collections import defaultdict

from foliomill.llm import mixing


def water(sizes, weights, most=3):
    total, free, cap, out = sum(sizes.values()), set(sizes), {s: most * n for s, n in sizes.items()}, {}
    while True:
        left, w = total - sum(out.values()), sum(weights[s] for s in free)
        level = left / w if w else 0
        over = [s for s in free if cap[s] < level * weights[s]]
        if not over:
            return out | {s: level * weights[s] for s in free}
        for s in over:
            out[s] = float(cap[s])
            free.discard(s)


def divisor(weights, seats):
    out = {k: 0 for k in weights}
    for _ in range(seats):
        best = min((k for k in weights if weights[k] > 0), key=lambda k: (-weights[k] / (2 * out[k] + 1), k))
        out[best] += 1
    return out


def test_apportion_equals_one_seat_at_a_time(spark):
    import random

    r = random.Random(2)
    rows, want = [], {}
    for g in range(40):
        n, seats = r.randrange(1, 30), r.choice([0, 1, 5, 40, 300])
        w = {k: r.choice([0.0, 1.0, r.random() * 100, float(r.randrange(50))]) for k in range(n)}
        if not any(w.values()):
            continue
        rows += [(g, k, x, seats) for k, x in w.items()]
        want |= {(g, k): q for k, q in divisor(w, seats).items()}
    df = spark.createDataFrame(rows, "g int, k int, w double, seats long")
    got = {(x["g"], x["k"]): x["quota"] for x in mixing.apportion(df, ["g"], ["k"], "w", "seats").collect()}
    assert got == want


def _docs(spark):
    rows = [(i, " ".join(["w"] * (i % 97)), None if i % 50 == 0 else f"s{min(i % 7, i % 3)}", "x") for i in range(4000)]
    rows += [(9000, "tiny doc", "zz", "x"), (9001, None, "empty", "x"), (5, "twice here", "s0", "x"), (5, "twice here", "s0", "x"), (None, "no id", "s1", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix_meets_targets(spark):
    got = mixing.mix(_docs(spark), shard_rows=300).collect()
    assert len(got) == _docs(spark).count()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted((s for s in size if s is not None)) + [None]
    want = water(dict(size), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 130 + 0.01 * target[s], s
    again = mixing.mix(_docs(spark).repartition(7), shard_rows=300).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_repeats_and_empty(spark):
    docs = _docs(spark)
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns and 0 < out.count() < 3 * docs.count() + 1
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("source = 'empty'")).collect()[0]["taken"] == 0


def test_copies_follow_the_mix(spark):
    from collections import Counter

    rows = [(i, "abc"[i % 3] if i % 7 else None, " ".join(["w"] * (i * 37 % 90)), i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, taken long")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += int(r["taken"] / max(r["size"], 1) + 0.5)
    got = Counter(r["doc_id"] for r in mixing.repeat_documents(docs).collect())
    assert got == +want and max(got.values()) <= 3
