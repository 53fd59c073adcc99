import hashlib
import random
import re

import numpy as np

from foliomill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(map(int, reversed(s)))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(d(m[0])) <= 19 and luhn(d(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(d(m[0])) <= 15]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(8)
    parts = ["a", "b.c", "@", ".", "1", "255", "256", "007", "-", " ", "+", "(", ")", "é", "%", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "x@y.z", "@@", "..", "1.2.3.4", "\n"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_are_linear():
    for t in ["a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1 " * 100_000, "@" * 100_000, "a@" * 100_000, "x-" * 100_000]:
        pii.added_spans(t, pii.base_spans(t), np.zeros(11))


def test_estimate_recovers_reliabilities():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.4
    right = [0.95, 0.9, 0.85, 0.8, 0.7, 0.9]
    cast = [0.9, 0.5, 0.6, 0.5, 0.4, 0.7]
    rows = {}
    for t in truth:
        p = "".join("-" if r.random() > c else "10"[int((r.random() < a) != t)] for a, c in zip(right, cast))
        rows.setdefault(p, [0, 0])[int(t)] += 1
    votes, n = list(rows), np.array([sum(x) for x in rows.values()], dtype=float)
    q, accuracy, share = pii.estimate(votes, n)
    assert np.abs(accuracy - right).max() < 0.04 and abs(share - 0.4) < 0.03
    guess = sum(max(x) if (q[i] > 0.5) == (x[1] >= x[0]) else min(x) for i, x in enumerate(rows.values()))
    assert guess > 0.93 * n.sum()


def _docs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(300):
        t = [word() for _ in range(30)]
        if i % 3 == 0:
            t[5] = 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'
            t[9] = f"{word()}@mail{i % 9}.example.com"
            t[12] = "".join(r.choice("0123456789") for _ in range(16))
        if i % 3 == 1:
            t[4] = f"version {i}.0 of 2024"
        rows.append((i, " ".join(t), 0, "x"))
    rows += [(900, None, 0, "x"), (901, "", 0, "x"), (902, "dup 1.2.3.4", 0, "x"), (902, "dup 1.2.3.4", 0, "x"), (None, "é a@b.co", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")


def test_spans_of_a_corpus(spark):
    docs = _docs(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = pii.personal_data(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        base = plain(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        if r["doc_id"] is not None and r["doc_id"] < 300:
            assert ("secret:" in r["spans"]) == (r["doc_id"] % 3 == 0)
            assert r["doc_id"] % 3 == 0 or r["spans"] == ""


def test_redaction(spark):
    docs = _docs(spark)
    out = pii.redact(docs, pii.train(docs))
    assert out.schema == docs.schema
    for r in out.collect():
        if r["text"] is not None:
            assert not plain(r["text"]) and r["n_chars"] == len(r["text"])
    assert pii.redact(docs.where("false"), pii.train(docs.where("false"))).count() == 0
    assert pii.personal_data(docs.where("false")).count() == 0


def planted(named, seed=8, n=600):
    """Texts with a secret or an account number (named by the word before it, or not), with contacts, and with harmless numbers."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    fill = lambda k: " ".join(pick("abcdefghijklmnoprstuvw", r.randrange(2, 9)) for _ in range(k))
    digits = lambda k: pick("123456789", 1) + pick("0123456789", k - 1)
    out = []
    for i in range(n):
        kind, s = None, ""
        name = ("api_key: ", "token=", "account: ", "IBAN ")[i % 4] if named else ""
        if i % 8 < 2:
            kind, s = "secret", pick("0123456789abcdef", r.choice([32, 40, 64])) if i % 8 == 0 else pick("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", r.choice([32, 36, 40]))
        elif i % 8 < 4:
            kind, s = "account", digits(r.choice([16, 17, 18])) if i % 8 == 2 else " ".join(digits(4) for _ in range(4))
        harmless = (f"name{i}@mail{i % 9}.com call +49 30 {digits(7)}", f"version {digits(8)} build {pick('0123456789abcdef', 20)} page {digits(10)}", f"isbn {digits(9)} rev {'0' * 12} no {digits(8)}", "")[i % 4]
        out.append((f"{fill(9)} {name}{s} {fill(8)}" if kind else f"{fill(8)} {harmless} {fill(6)}", kind, s))
    return out


def test_recall_of_the_added_kinds():
    for named, least in ((True, {"secret": 0.99, "account": 0.99}), (False, {"secret": 0.99, "account": 0.6})):
        docs = planted(named)
        counts = {}
        for t, _, _ in docs:
            base = pii.base_spans(t)
            for span in (*base, *pii.more_candidates(t, base)):
                key = pii.votes_and_features(t, *span)
                counts[key] = counts.get(key, 0) + 1
        n = np.array(list(counts.values()), dtype=float)
        weights = pii.fit([f for _, f in counts], pii.estimate([v for v, _ in counts], n)[0], n)
        found, all_ = {"secret": 0, "account": 0}, {"secret": 0, "account": 0}
        for t, kind, s in docs:
            base = pii.base_spans(t)
            added = pii.added_spans(t, base, weights)
            if kind:
                all_[kind] += 1
                found[kind] += any(s in t[a:b] for _, a, b in [*base, *added])
            else:
                assert not added
        assert all(found[k] >= least[k] * all_[k] for k in all_), (named, found, all_)
