import re
from collections import Counter

from foliomill.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = W.findall(t)
    lines, seen, dups = [x for x in t.split("\n") if W.search(x)], set(), 0
    for x in lines:
        dups += x in seen
        seen.add(x)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dups, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_counts(spark):
    texts = ["", None, " \n\t ", "a b c a b c d", "a a a a", "x\ny\nx\n \nx", "é漢 #1 <b>|&", "one two", "\x0b\x0c\r a b", "\\n$ * %", "w " * 30_000] + [" ".join(f"w{i % m}" for i in range(120)) for m in (7, 50, 100, 119, 120)]
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", "u", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, stratum string, upper int")
    for r in quality.features(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(texts[r["doc_id"]]), texts[r["doc_id"]][:50]


def test_binomial_tail(spark):
    from math import comb

    rows = [(k, n) for n in (1, 5, 40, 900) for k in (0, 1, 3, 8) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(df.k, df.n, 0.02).alias("p")).collect():
        want = sum(comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert abs(r["p"] - (1.0 if r["k"] >= r["n"] * 0.02 else want)) < 1e-9


def _docs(spark, n=3000):
    rows = []
    for i in range(n):
        junk = i % 10 == 0
        words = [f"w{(i * 31 + j * j) % 5003}" for j in range(80)]
        rows.append((i, " ".join(w + ("###" if junk else "") for w in words), ["en", "fr"][i % 2], 0 if junk else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_limits_hold_and_junk_goes(spark):
    docs = _docs(spark)
    got = {r["doc_id"]: r for r in quality.assess(docs, docs.select("doc_id", "quality")).collect()}
    good = [i for i in got if i % 10]
    assert sum(not got[i]["kept"] for i in good) <= 0.02 * len(good)
    assert not any(got[i]["kept"] for i in got if i % 10 == 0)


def test_cutoffs_against_brute_force(spark):
    docs = _docs(spark, 4000)
    feats = quality.features(docs)
    labels = docs.select("doc_id", "quality")
    got = {(r["stratum"], r["rule"]): (r["cutoff"], r["lost"], r["n"]) for r in quality.cutoffs(feats, labels, 0.02, 0.1).collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    rows = [r for r in feats.collect() if r["doc_id"] in good and not r["base_failed"]]
    from math import comb

    for stratum in ("en", "fr"):
        own, want = [r for r in rows if r["stratum"] == stratum], None
        for c in range(quality.GRID - 1, -1, -1):
            cuts = {rule: lo + c * (hi - lo) / quality.GRID for rule, (lo, hi) in quality.RULES.items()}
            k, n = sum(any(r[rule] > cut + 1e-12 for rule, cut in cuts.items()) for r in own), len(own)
            if k >= 0.02 * n or sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) > 0.1 / 2:
                break
            want = (cuts, k, n)
        assert want is not None
        for rule, cut in want[0].items():
            assert abs(got[stratum, rule][0] - cut) < 1e-9 and got[stratum, rule][1:] == want[1:]


def test_delta_goes_to_strata_that_can_act(spark):
    docs = _docs(spark, 1500)
    few = docs.where("lang = 'en' or doc_id < 300")
    labels = docs.select("doc_id", "quality")
    got = quality.cutoffs(quality.features(few), labels, 0.01, 0.05).collect()
    # 675 good documents suffice for a whole delta, though not the 135 of the other stratum
    assert {(r["stratum"], r["n"]) for r in got} == {("en", 600)}


def test_no_evidence_no_cutoff(spark):
    docs = _docs(spark, 60)
    labels = docs.select("doc_id", "quality")
    assert quality.cutoffs(quality.features(docs), labels).count() == 0
    assert quality.assess(docs, labels.where("false")).where("kept").count() == 60
    assert quality.assess(docs.where("false"), labels).count() == 0
    both = labels.union(labels.selectExpr("doc_id", "1 - quality"))
    assert quality.cutoffs(quality.features(docs), both).count() == 0


def test_keep_documents_keeps_columns(spark):
    docs = _docs(spark, 60)
    out = quality.keep_documents(docs, docs.select("doc_id", "quality"))
    assert out.columns == docs.columns and out.count() == 60
