import random
import re

import numpy as np
import pytest

from foliomill.llm import jaccard, shingles
from foliomill.llm.signature_tree import SetForest

W = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(texts):
    out = []
    for t in texts:
        w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(ids, texts, num=75, den=100):
    s, root = sets_of(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and den * both >= num * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {(ids[i], len(s[i]), least[find(i)]) for i in range(len(s))}


def corpus(seed, n=250):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [" ".join(r.choice(vocab) for _ in range(30)) for _ in range(3)]
    out = []
    while len(out) < n:
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 8, 40, 120, 300]))]
        if r.random() < 0.3:
            base += r.choice(shared).split()
        for _ in range(r.choice([1, 1, 2, 12])):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, len(t) // 40, len(t) // 25])):
                k = r.randrange(len(t))
                t[k : k + 1] = [r.choice(vocab)] * r.choice([0, 1, 2])
            out.append(" ".join(t).title() if r.random() < 0.2 else " \n ".join(t) if r.random() < 0.2 else " ".join(t))
    return out[:n] + ["", None, " \t", "a b", "A  B", "one", "é b c d e f"]


def test_shingle_sets():
    texts = [t or "" for t in corpus(1)]
    got = shingles.shingle_sets(texts)
    assert [len(x) for x in got] == [len(x) for x in sets_of(texts)]
    i = next(i for i, t in enumerate(texts) if len(t) > 300)
    old, shingles.SEGMENT = shingles.SEGMENT, 50
    try:
        assert all((a == b).all() for a, b in zip(got, shingles.shingle_sets(texts)))
    finally:
        shingles.SEGMENT = old
    assert (shingles.shingle_sets([texts[i].upper()])[0] == shingles.shingle_sets([texts[i].lower()])[0]).all()


def test_words_of_a_repeating_pattern_are_told_apart():
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = shingles.shingle_sets([f"{word} one two three four five", f"{other} one two three four five"])
    assert len(a) == len(b) == 2 and len(np.intersect1d(a, b)) == 1
    many = shingles.shingle_sets([f"w{i} " * 1 + "x" * (i % 37) for i in range(50_000)])
    assert len(np.unique(np.concatenate(many))) == len({(f"w{i}", "x" * (i % 37)) for i in range(50_000)})


def test_sets_that_share_half_a_digest_stay_apart(spark):
    rows = [(1, 5, 7, 1), (2, 5, 8, 1), (3, 5, 7, 1), (4, 6, 7, 1), (5, 0, 0, 0)]
    got = jaccard.one_set_each(spark.createDataFrame(rows, "doc_id long, d long, e long, n long")).collect()
    d = {r["doc_id"]: r["d"] for r in got}
    assert d[1] == d[3] == 5 and d[2] not in (5, 6) and d[4] == 6 and len(got) == 5


@pytest.mark.parametrize("seed", [2, 3])
def test_tree_equals_all_pairs(seed):
    texts = [t or "" for t in corpus(seed, 400)]
    sets = shingles.shingle_sets(texts)
    plain = sets_of(texts)
    ids = list(range(len(texts)))
    want = {i: c for i, _, c in brute(ids, texts)}
    root = SetForest(sets, 75, 100).link(np.arange(len(sets)))
    assert {i: int(root[i]) for i in ids} == want
    f = SetForest(sets, 75, 100)
    left, right = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
    f.join(left, right)
    f.settle()
    for i in left:
        for j in right:
            a, b = plain[i], plain[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                assert f.root[i] == f.root[j]


@pytest.mark.parametrize("chunk,sample", [(2048, 16_384), (3, 16_384), (2048, 2)])
def test_components_against_brute_force(spark, monkeypatch, chunk, sample):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    texts = corpus(7, 200)
    ids = random.Random(1).sample(range(1000), len(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n string").repartition(3)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(df).collect()]
    assert len(got) == len(texts) and set(got) == brute(ids, texts)


def test_empty_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar_components(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (4, 4), (None, 1)]
    assert jaccard.similar_components(df.where("false")).count() == 0


def test_one_of_each(spark):
    texts = corpus(9, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in jaccard.one_of_each(df).collect()}
    assert left == {c for _, _, c in brute(list(range(len(texts))), texts)}


def test_a_star_names_its_centre():
    import pyarrow as pa

    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:j] + ["x"] + base[j + 1 :]) for j in range(3, 60, 6)] + [" ".join(base), "quite another text of some words"]
    d = [jaccard.digest(x)[0] for x in shingles.shingle_sets(texts)]
    n = len(texts)
    table = pa.table({"d": d, "text": texts, "left": [i == n - 2 for i in range(n)], "right": [False] * n, "linked": [False] * n})
    got = jaccard._task(jaccard._star, 5, 75, 100)(table)
    assert set(got.column("b").to_pylist()) == {d[-2]} and sorted(got.column("a").to_pylist()) == sorted(d[:-2])


def test_large_blocks_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(r.choice([1, 2, 4, 8])):
            t[r.randrange(len(t))] = f"y{r.randrange(9999)}"
        texts.append(" ".join(t))
    ids = list(range(len(texts)))
    got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.similar_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert got == brute(ids, texts)


def _near_copies(n, words=150):
    r = random.Random(4)
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.choice([1, 2, 4, 8])):
            t[r.randrange(len(t))] = f"y{r.randrange(9999)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("chunk", [2048, 7])
def test_every_link_is_counted_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = corpus(7, 120) + _near_copies(60) + _near_copies(3)
    s = sets_of(texts)
    want = [sum(i != j and bool(s[i]) and bool(s[j]) and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]) for j in range(len(s))) for i in range(len(s))]
    ids = list(range(len(texts)))
    got = jaccard.link_counts(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["n_links"]) for r in got} == set(zip(ids, want)) and len(got) == len(texts)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(ids, texts)


def test_a_text_of_several_segments():
    r = random.Random(6)
    text = " ".join(f"w{r.randrange(5000)}" for _ in range(260_000))
    assert len(text) > shingles.SEGMENT
    got = shingles.shingle_sets([text, "a b", text])
    assert len(got[0]) == len(sets_of([text])[0]) and (got[0] == got[2]).all() and len(got[1]) == 1
