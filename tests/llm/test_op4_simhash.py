import hashlib
import random

from pyspark.sql import functions as F

from foliomill.llm import simhash


def _texts():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(2000)]
    out = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 200))) for _ in range(700)]
    return out + ["", None, "é漢字 one two", out[3], "x"]


def test_edited_texts_and_order(spark):
    texts = _texts()
    df = spark.createDataFrame([(i * 3, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, bucket string").repartition(5)
    got = {r["doc_id"]: r for r in simhash.edited_likeness(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt, r = t or "", texts[i - 1] or "", got[i * 3]
        k = len(t) // 3
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert r["near_edited"] == bits(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == bits(r["fingerprint"], got[(i - 1) % len(texts) * 3]["fingerprint"])
    assert got[3 * 3]["fingerprint"] == got[(len(texts) - 2) * 3]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 200]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.97 * len(long)


def test_votes_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_texts()[:60] + ["a b c d e a b c d e", "one"])], "doc_id long, text string")
    terms = {r["doc_id"]: r["h"] for r in df.select("doc_id", simhash.term_hashes(F.col("text")).alias("h")).collect()}
    for r in simhash.fingerprints(df).collect():
        want = sum(1 << k for k in range(64) if sum(1 if (h >> k) & 1 else -1 for h in terms[r["doc_id"]]) > 0)
        assert r["fp"] & (2**64 - 1) == want


def test_ties_nulls_and_small_tables(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "null id"), (2, "b")], "doc_id long, text string")
    assert simhash.edited_likeness(df).count() == 4
    one = simhash.edited_likeness(df.where("doc_id = 2")).collect()
    assert one[0]["near_next"] == 1.0
    assert simhash.edited_likeness(df.where("false")).count() == 0


def test_radius_search_against_brute_force(spark):
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(150)]
    for f in fps[:40]:
        for _ in range(3):
            g = f
            for k in r.sample(range(64), r.randrange(1, 6)):
                g ^= 1 << k
            fps.append(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = [signed(f) for f in fps] + [signed(fps[0])]
    u = sorted(set(fps))
    want = {(a, b) for i, a in enumerate(u) for b in u[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    df = spark.createDataFrame([(f,) for f in fps] + [(None,)], "fp long")
    for hot in (256, 3, 1):
        got = [(x["a"], x["b"]) for x in simhash.within_radius(df, hot=hot).collect()]
        assert set(got) == want and len(got) == len(set(got))


def test_near_counts_against_brute_force(spark):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = [f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) if r.random() < 0.5 else f for f in base for _ in range(12)] + [0, 0, 2**64 - 1]
    rows = [(100 - i, f"{f:016x}") for i, f in enumerate(prints)] + [(None, f"{prints[0]:016x}")]
    got = simhash.near_counts(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    assert len(got) == len(rows)
    value = [int(f, 16) for _, f in rows]
    for x in got:
        near = [i for (i, _), v in zip(rows, value) if bin(v ^ int(x["fingerprint"], 16)).count("1") <= 3]
        assert x["n_near"] == len(near) - 1
        assert x["near_id"] == min(i for i in near if i is not None)
    assert simhash.near_counts(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0
