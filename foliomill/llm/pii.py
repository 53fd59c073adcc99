"""Personal data by weak supervision.

Base spans are exact matches of four kinds: email, ip, card, phone. They always stand. Further candidates (long digit groups, long mixed
tokens) and the base spans themselves are voted on by labelers: regex shapes, gazetteers and the words before a span; each says private,
not private or nothing. Votes and features are counted over the whole corpus as patterns, whose number is fixed by the labelers, so only
a small table reaches the driver. Expectation-maximisation estimates how reliable each labeler is and how likely each pattern is to be
private; a logistic classifier is then fitted to those likelihoods on the span's features, and adds each candidate it scores at
THRESHOLD or more. Candidates that overlap a base span are never added.

Defined cases: a null text is empty; empty texts have no spans; equal texts have equal spans; offsets count code points, ends exclusive;
very long texts are scanned once by patterns that don't backtrack over long runs; an empty table gives an empty table and a model that adds
nothing; other columns are kept by redact() and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "account")
THRESHOLD, ROUNDS = 0.9, 60
CONTEXT = 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is entered at its start only: a match from its middle exists only where one from its start does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")
_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")

# Fixed word lists of the gazetteer and context labelers.
TLDS = frozenset("com org net edu gov mil int info biz io co de fr es it nl uk us ca ch at be pt pl se no dk fi ie eu".split())
SECRET_WORDS = re.compile(r"\b(?:token|secret|passwd|password|pwd|api[_-]?key|key|bearer|auth|credential)\b\W*$", re.I)
CONTACT_WORDS = re.compile(r"\b(?:e-?mail|mail|contact|phone|tel|telephone|call|mobile|fax|ip|host|server|address|card|visa|account|iban|konto|tarjeta|carte|cuenta|compte)\b\W*(?:\w+\W+)?$", re.I)
HARMLESS_WORDS = re.compile(r"\b(?:version|v|page|chapter|section|isbn|issn|doi|rev|revision|commit|build|no|nr)\b\W*$", re.I)
#: Leading digits of issued cards.
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "38", "60", "62", "64", "65")

LABELERS = ("shape", "check_digits", "gazetteer", "context", "harmless_context", "variety")
FEATURES = ("is_secret", "is_account", "is_email", "is_number", "card_length", "hex", "mixed", "quoted", "long", "named")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, each sought from its @ and so without backtracking over long words."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        elif start < at:
            end = max(end, start)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base kinds, ordered by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def more_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the method may add: kinds secret and account, none overlapping a base span or another."""
    if not _DIGIT.search(text):
        return []
    taken = sorted((a, b) for _, a, b in base)
    out: list[tuple[str, int, int]] = []

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b, -1))
        return all(e <= a for _, e in taken[max(0, i - 2) : i])

    for m in _TOKEN.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and free(*m.span()):
            out.append(("secret", *m.span()))
    taken = sorted([*taken, *((a, b) for _, a, b in out)])
    for m in _CARD.finditer(text):
        if 8 <= len(_digits(m[0])) <= 24 and free(*m.span()):
            out.append(("account", *m.span()))
    return out


def votes_and_features(text: str, kind: str, start: int, end: int) -> tuple[str, str]:
    """One character a labeler (1 private, 0 not, - no vote) and one a feature (0 or 1)."""
    s, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = _digits(s)
    number = kind in ("card", "phone", "account", "ip")
    if kind == "secret":
        shape = "1" if len(s) >= 32 else "-"
        check = "1" if _HEX.fullmatch(s) and len(s) in (32, 40, 48, 56, 64, 96, 128) else "-"
        gaz = "-"
    elif kind == "email":
        shape, check, gaz = "1", "-", "1" if s.rpartition(".")[2].lower() in TLDS else "-"
    elif kind == "ip":
        shape, check, gaz = "1", "1", "0" if s.startswith(("0.", "127.", "255.")) else "-"
    elif kind == "phone":
        shape, check, gaz = "1", "-", "1" if "(" in s or " " in s else "-"
    else:
        shape = "1" if 13 <= len(digits) <= 19 else "0" if len(digits) < 12 else "-"
        check = "1" if _luhn(digits) else "0" if kind == "card" else "-"
        gaz = "1" if digits.startswith(ISSUERS) else "-"
    context = "1" if (SECRET_WORDS if kind == "secret" else CONTACT_WORDS).search(before) else "-"
    harmless = "0" if HARMLESS_WORDS.search(before) else "-"
    kinds = len(set(s.lower()))
    variety = "0" if kinds <= 3 else "1" if kinds >= 8 else "-"
    features = (
        kind == "secret", kind == "account", kind == "email", number, number and len(digits) in (13, 14, 15, 16, 19), bool(_HEX.fullmatch(s)),
        any(c.isupper() for c in s) and any(c.islower() for c in s), before[-1:] in "\"'", len(s) >= 32, context == "1",
    )
    return "".join((shape, check, gaz, context, harmless, variety)), "".join("1" if f else "0" for f in features)


def pattern_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """votes, features, n over all spans of the corpus; at most 3^6 * 2^10 rows, far fewer in fact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and ("@" in t or _DIGIT.search(t)):
                    base = base_spans(t)
                    for span in (*base, *more_candidates(t, base)):
                        key = votes_and_features(t, *span)
                        counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in counts], pa.string()), pa.array([f for _, f in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["votes", "features", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "votes string, features string, n long").groupBy("votes", "features").agg(F.sum("n").alias("n"))


def estimate(votes: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: how likely each vote pattern is private, each labeler's accuracy, the share that is private.

    A labeler is right with its accuracy whenever it votes; accuracies carry a prior of 8 right in 10, so that labelers are taken to be
    better than chance and rare ones stay near it.
    """
    v = np.array([[{"1": 1, "0": -1, "-": 0}[c] for c in p] for p in votes], dtype=np.float64).reshape(len(votes), len(LABELERS))
    accuracy, share = np.full(v.shape[1], 0.8), 0.5
    q = np.full(len(votes), 0.5)
    for _ in range(ROUNDS):
        weight = np.log(accuracy / (1 - accuracy))
        q = 1 / (1 + np.exp(-(v @ weight + np.log(share / (1 - share)))))
        right = ((v > 0) * q[:, None] + (v < 0) * (1 - q)[:, None]) * n[:, None]
        cast = (v != 0) * n[:, None]
        accuracy = np.clip((right.sum(axis=0) + 8) / (cast.sum(axis=0) + 10), 0.05, 0.99)
        share = float(np.clip(((q * n).sum() + 1) / (n.sum() + 2), 0.02, 0.98))
    return q, accuracy, share


def fit(features: list[str], q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier (bias first) for the likelihoods q, by Newton steps with a ridge."""
    x = np.array([[1, *map(int, f)] for f in features], dtype=np.float64).reshape(len(features), 1 + len(FEATURES))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - q)) + 0.1 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray | None:
    """The classifier's weights, or None where the corpus has no candidates."""
    rows = pattern_counts(docs, text_col).orderBy("votes", "features").collect()  # bounded by the number of patterns
    if not rows:
        return None
    n = np.array([r["n"] for r in rows], dtype=np.float64)
    q, _, _ = estimate([r["votes"] for r in rows], n)
    return fit([r["features"] for r in rows], q, n)


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray | None) -> list[tuple[str, int, int]]:
    if weights is None:
        return []
    out = []
    for span in more_candidates(text, base):
        f = votes_and_features(text, *span)[1]
        z = weights[0] + sum(w for w, c in zip(weights[1:], f) if c == "1")
        if 1 / (1 + np.exp(-z)) >= THRESHOLD:
            out.append(span)
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and added, kind:start:end) of every document."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, spans = [[] for _ in range(4)], [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                for k, kind in enumerate(KINDS[:4]):
                    n[k].append(sum(s[0] == kind for s in base))
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined([*base, *added_spans(t or "", base, weights)]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, weights: np.ndarray | None) -> str:
    """text with each span replaced by its kind; overlapping spans are replaced together, under the kind that starts first."""
    base = base_spans(text)
    spans = sorted([*base, *added_spans(text, base, weights)], key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the personal data of each text replaced, and its length column (if there is one) brought up to date."""
    schema, names = docs.schema, docs.columns
    at = names.index(text_col)
    long = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None or not ("@" in t or _DIGIT.search(t)) else redact_text(t, weights) for t in b.column(at).to_pylist()]
            new = pa.array(texts, pa.string())
            cols = list(b.columns)
            cols[at] = new
            if long is not None:
                cols[long] = pc.if_else(pc.is_valid(new), pc.utf8_length(new).cast(b.column(long).type), b.column(long))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))
