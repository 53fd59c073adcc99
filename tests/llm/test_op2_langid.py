import math
import random
import zlib
from collections import Counter

import numpy as np

from foliomill.llm import langid


def plain(text):
    out = []
    for c in text:
        x = c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " "
        if x != " " or (out and out[-1] != " "):
            out.append(x)
    return "".join(out) + ("" if not out or out[-1] == " " else " ")


def kn(texts):
    """A plain interpolated Kneser-Ney model as a function of (context, symbol)."""
    n = langid.ORDER
    tables = [Counter() for _ in range(n + 1)]
    for t in texts:
        s = " " * (n - 1) + plain(t)
        for i in range(n - 1, len(s)):
            tables[n][s[i - n + 1 : i + 1]] += 1
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    size = len(tables[1]) + 1

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / size
        t = tables[k]
        once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        own = {g: v for g, v in t.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        return max(t[gram] - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(gram[1:])

    return p


def test_model_equals_a_plain_one():
    texts = ["Das ist ein Haus, ein Haus.", "die Katze ist da", "Ein Baum? und noch ein Baum!", "é漢 x"]
    h, s, n = langid.count_grams(texts)
    grams = ["".join(map(chr, row)) for row in s]
    model = langid.Model(grams, n)
    p = kn(texts)
    for text in ["ein haus", "zzz qq", "die Maus ist 12 da", "é漢 x", "a"]:
        e, letters = langid.Identifier([model]).entropies([text])
        s = " " * (langid.ORDER - 1) + plain(text)
        own = [math.log(p(s[i - langid.ORDER + 1 : i + 1])) for i in range(langid.ORDER - 1, len(s))]
        assert abs(e[0, 0] + sum(own) / len(own)) < 1e-5
        assert letters[0] == sum(c.isalpha() for c in text)
    assert abs(sum(p("ein "[-3:] + c) for c in {g[-1] for g in grams} | {"Q"}) - 1) < 1e-9


def _docs(spark, n=600):
    r = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "auf"], "cc": ["tion", "eux", "ê", "que"]}
    rows = []
    for i in range(n):
        lang = "abc"[i % 3] * 2
        text = " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40)))
        rows.append((i, text, lang, "x"))
    rows += [(n, None, "aa", "x"), (n + 1, "12 !? \n", "bb", "x"), (n + 2, "ka lo mi", None, "x"), (None, "ein auf", "bb", "x"), (3, "ein schung auf", "bb", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, best string")


def test_held_out_accuracy(spark):
    docs = _docs(spark)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect() if r["doc_id"] != 3}
    got = langid.identify(docs.repartition(3)).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) and r["lang_pred"] != "und"]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) > 0.97 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert {r["doc_id"]: r["lang_pred"] for r in got}[600] == "und" and {r["doc_id"]: r["lang_pred"] for r in got}[601] == "und"


def test_nothing_to_learn(spark):
    docs = _docs(spark)
    assert langid.identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_long_texts_and_cache(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abc de") for _ in range(50)) for _ in range(40)]
    h, s, n = langid.count_grams(texts)
    model = langid.Model(["".join(map(chr, row)) for row in s], n)
    want, _ = langid.Identifier([model, model]).entropies(texts)
    monkeypatch.setattr(langid.Identifier, "CACHE", 50)
    own = langid.Identifier([model, model])
    got = np.concatenate([own.entropies([t])[0] for t in texts])
    assert np.allclose(got, want)
    merged = langid.merge_counts([langid.count_grams(texts[:20]), langid.count_grams(texts[20:])])
    assert dict(zip(merged[0].tolist(), merged[2].tolist())) == dict(zip(h.tolist(), n.tolist()))


def test_monotone_scores():
    x = langid.monotone(np.array([1, 0, 5, 9]), np.array([10, 10, 10, 10]))
    assert (np.diff(x) >= 0).all() and len(x) == 4


def _assembled(trained):
    """Whole models from all parts, whatever the passes."""
    by = {x: [] for x in trained.langs}
    for r in trained.parts.toArrow().to_pylist():
        by[r["lang"]].append(r)
    return [trained.low[x].extended(by[x]) for x in trained.langs]


def test_no_gram_is_dropped(spark, monkeypatch):
    """However little a pass holds, the models are those of all grams, and passes give what one pass gives."""
    docs = _docs(spark, 300)
    rows = docs.selectExpr("doc_id", "cast(coalesce(doc_id, 0) % 5 as int) as fold", "lang", "text")
    whole = sorted(map(str, langid.identify(docs).collect()))
    monkeypatch.setattr(langid, "MODEL_GRAMS", 60)
    monkeypatch.setattr(langid, "SLOT_GRAMS", 40)
    trained = langid.train(rows.where("fold > 1"))
    assert len(trained.passes) > 3 and sorted(x for _, s in trained.passes for x in s) == list(range(trained.slots))
    for lang, got in zip(trained.langs, _assembled(trained)):
        texts = [r["text"] for r in rows.where("fold > 1 and text is not null").where(docs["lang"] == lang).collect()]
        _, s, n = langid.count_grams(texts)
        want = langid.Model(["".join(map(chr, x)) for x in s], n)
        assert got.uniform == want.uniform and len(got.grams[langid.ORDER][0]) == len(n)
        for k in range(1, langid.ORDER + 1):
            for a, b in zip(got.grams[k] + got.contexts[k], want.grams[k] + want.contexts[k]):
                assert np.allclose(a, b, rtol=1e-6, atol=0)
    got = sorted(map(str, langid.identify(docs).collect()))
    cut = lambda rows: [[x[:9] for x in r.split("=")] for r in rows]
    assert cut(got) == cut(whole)


def test_all_languages_are_learned(spark, monkeypatch):
    docs = _docs(spark, 300)
    whole = sorted(map(str, langid.identify(docs).collect()))
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    got = langid.identify(docs).collect()
    assert {r["lang_pred"] for r in got} == {"aa", "bb", "cc", "und"}
    cut = lambda rows: [[x[:9] for x in r.split("=")] for r in rows]
    assert cut(sorted(map(str, got))) == cut(whole)
