"""Language identification by interpolated Kneser-Ney character models, stored in sorted hash arrays.

Texts become symbols: lower-cased letters, and one blank for each run of anything else. Every training document's ORDER-grams are counted,
by language, over the whole corpus; tasks count with numpy and only distinct grams are shuffled. Counts of the highest order are
occurrences, those of lower orders are distinct left neighbours, each with its own discount, and every probability interpolates with the
order below down to a uniform one. A model is, for each order, a sorted array of 64-bit gram hashes with log probabilities and one
of context hashes with log back-off weights.

The language with the lowest cross-entropy per symbol wins. Rejection is calibrated on documents that were kept from the counts (CALIBRATION
fold): the score is the share of right answers at a like margin over the runner-up, made monotone; a document is marked rejected if its
score is below half or its cross-entropy exceeds what all but TAIL of that language's documents have.

Size. No gram is dropped: discounts, totals and continuation counts are taken over all distinct grams. The two symbols before the last one
put a gram into one of CELLS cells. All that orders above LOW look up for a place of a text lies in one cell, so the tasks build their part
of a model by themselves. The driver builds only orders up to LOW, which grow with the square of the alphabet. Texts are scored in passes of
some cells each, so that a worker holds about MODEL_GRAMS grams of the highest order; sums of the passes are added by the text's 128-bit hash.
All languages are learned; a pass holds at most LANGUAGES of them.

Defined cases: a text that is null or has no letter is `und`, score 0, not rejected; ties go to the first language by name; without any
learned language all is `und`; texts of more than PIECE characters are read in pieces that start anew; a null id is never learned from;
equal texts get equal answers; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata  # noqa: F401  (str.isalpha and str.lower follow its version)
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ORDER, FOLDS, CALIBRATION = 5, 5, 1
MODEL_GRAMS, LANGUAGES = 1 << 21, 256
#: Orders that the driver builds; cells that grams fall in; grams of all languages that a task builds at a time, about.
LOW, CELLS, SLOT_GRAMS = 2, 4096, 25_000
TAIL, MARGIN_BINS, BIN = 0.01, 80, 0.025
PIECE, ROWS = 400_000, 400_000
_SPACE = 32
_RNG = np.random.default_rng(77)
_PLACE = _RNG.integers(1, 2**63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """The symbol of each code point of the basic plane."""
    if not _FOLDED:
        t = np.full(0x10000, _SPACE, dtype=np.uint32)
        for c in range(0x10000):
            if (x := chr(c)).isalpha():
                t[c] = ord(low) if len(low := x.lower()) == 1 else c
        _FOLDED.append(t)
    return _FOLDED[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in a row, each text led by ORDER - 1 blanks and, after letters, ended by one; and where each ends."""
    raw = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), length + 1)
    s = _folded()[np.minimum(raw, 0xFFFF)].copy()
    for i in np.flatnonzero(raw > 0xFFFF):
        s[i] = ord(x.lower()) if (x := chr(int(raw[i]))).isalpha() and len(x.lower()) == 1 else _SPACE
    keep = (s != _SPACE) | np.concatenate([[False], s[:-1] != _SPACE])  # the first blank after letters
    s, owner = s[keep], owner[keep]
    n = np.bincount(owner, minlength=len(texts))
    lead = ORDER - 1
    ends = np.cumsum(n + lead)
    out = np.full(int(ends[-1]) if len(ends) else 0, _SPACE, dtype=np.uint32)
    out[np.arange(len(s)) + lead * (owner + 1)] = s
    return out, ends


def gram_hashes(s: np.ndarray) -> list[np.ndarray]:
    """h[k][i]: the hash of the k symbols that end at i, for k from 0 to ORDER."""
    acc, out = np.zeros(len(s), dtype=np.uint64), [np.zeros(len(s), dtype=np.uint64)]
    wide = s.astype(np.uint64)
    for k in range(ORDER):
        acc = acc.copy()
        acc[k:] += (wide[: len(s) - k] + np.uint64(1)) * _PLACE[k]
        x = acc + _PLACE[ORDER] // np.uint64(k + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(x ^ (x >> np.uint64(29)))
    return out


def _cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell of a place or gram, from the two symbols before its last."""
    x = a.astype(np.uint64) * _PLACE[0] + b.astype(np.uint64) * _PLACE[1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(CELLS)).astype(np.int32)


def _inside(ends: np.ndarray) -> np.ndarray:
    """Places that are symbols of a text, not the blanks that lead it."""
    starts = np.concatenate([[0], ends[:-1]])
    mark = np.ones(int(ends[-1]) if len(ends) else 0, dtype=bool)
    for k in range(ORDER - 1):
        mark[starts + k] = False
    return mark


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, a place of each, and for every place the index of its value."""
    order = np.argsort(x)
    s = x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, dtype=bool)
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], order[new], inverse


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, symbols (a row each) and count of the distinct ORDER-grams."""
    s, ends = symbols(texts)
    at = np.flatnonzero(_inside(ends))
    h, first, inverse = distinct(gram_hashes(s)[ORDER][at])
    return h, s[at[first][:, None] + np.arange(1 - ORDER, 1)], np.bincount(inverse, minlength=len(h))


def merge_counts(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, s, n = (np.concatenate(x) for x in zip(*parts))
    u, first, inverse = distinct(h)
    return u, s[first], np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, cell, gram, n over all rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        parts: dict[str, list[tuple]] = {}

        def count(lang: str) -> None:
            parts.setdefault(lang, []).append(count_grams(held.pop(lang)))
            size[lang] = 0
            if len(parts[lang]) >= 8:
                parts[lang] = [merge_counts(parts[lang])]

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in range(0, len(text), PIECE):
                    held.setdefault(lang, []).append(text[k : k + PIECE])
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= ROWS:
                    count(lang)
        for lang in list(held):
            count(lang)
        for lang, own in parts.items():
            _, s, n = merge_counts(own)
            for k in range(0, len(n), 50_000):
                letters = np.ascontiguousarray(s[k : k + 50_000]).tobytes().decode("utf-32-le", "surrogatepass")
                grams = [letters[i : i + ORDER] for i in range(0, len(letters), ORDER)]
                cells = _cells(s[k : k + 50_000, ORDER - 3], s[k : k + 50_000, ORDER - 2])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(cells), pa.array(grams), pa.array(n[k : k + 50_000])], names=["lang", "cell", "gram", "n"])

    return rows.mapInArrow(run, "lang string, cell int, gram string, n long").groupBy("lang", "cell", "gram").agg(F.sum("n").alias("n"))


def _hashed(grams: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all orders and the place where each gram (of ORDER symbols) ends."""
    # hashes depend only on symbols, so one row of symbols for each gram gives those of all orders
    s = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(grams), ORDER)
    flat = np.concatenate([np.full((len(grams), 1), _SPACE, dtype=np.uint32), s], axis=1).reshape(-1)
    return gram_hashes(flat), np.arange(len(grams)) * (ORDER + 1) + ORDER


def _discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def _shorter(h: list[np.ndarray], at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct gram of k - 1 symbols and its count of distinct left neighbours, from the distinct grams of k."""
    _, first, same = np.unique(h[k - 1][at], return_index=True, return_inverse=True)
    return at[first], np.bincount(same).astype(np.float64)


def _level(h: list[np.ndarray], at: np.ndarray, n: np.ndarray, k: int, d: float) -> tuple:
    c = h[k - 1][at - 1] if k > 1 else np.zeros(len(at), dtype=np.uint64)
    ctx, of = np.unique(c, return_inverse=True)
    total, kinds = np.bincount(of, weights=n), np.bincount(of)
    return k, h[k][at], h[k - 1][at], np.maximum(n - d, 0) / total[of], ctx, d * kinds / total, of


def _interpolated(levels: list[tuple], below_h: np.ndarray, below_p: np.ndarray) -> Iterator[tuple]:
    """k, sorted grams, probabilities, contexts and weights, from the lowest order up; below: the order under the lowest."""
    for k, g, suffix, direct, ctx, weight, of in reversed(levels):
        lower = below_p[np.searchsorted(below_h, suffix)] if k > 1 else below_p[np.zeros(len(g), dtype=np.int64)]
        p = direct + weight[of] * lower
        order = np.argsort(g)
        below_h, below_p = g[order], p[order]
        yield k, below_h, below_p, ctx, weight


class Model:
    """One language: for each order, sorted hashes of grams and contexts with their logarithms."""

    def __init__(self, grams: list[str], counts: np.ndarray, top: int = ORDER):
        """Orders up to top, from the distinct grams of the order top, each led by blanks up to ORDER symbols."""
        (h, at), n = _hashed(grams), counts.astype(np.float64)
        levels = []
        for k in range(top, 0, -1):
            levels.append(_level(h, at, n, k, _discount(float((n == 1).sum()), float((n == 2).sum()))))
            at, n = _shorter(h, at, k)
        size = len(levels[-1][1]) + 1
        self.uniform = -math.log(size)
        none = np.empty(0, np.uint64), np.empty(0, np.float32)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = [none] * (ORDER + 1)
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = [none] * (ORDER + 1)
        for k, g, p, ctx, weight in _interpolated(levels, np.zeros(1, dtype=np.uint64), np.array([1.0 / size])):
            self.grams[k] = g, np.log(p).astype(np.float32)
            self.contexts[k] = ctx, np.log(weight).astype(np.float32)
        self.top = g, p

    def extended(self, parts: list[dict]) -> Model:
        """This model with the parts (k, grams, logs, contexts, weights as bytes) of higher orders that some cells have."""
        out = Model.__new__(Model)
        out.uniform, out.grams, out.contexts = self.uniform, list(self.grams), list(self.contexts)
        for k in {x["k"] for x in parts}:
            own = [x for x in parts if x["k"] == k]
            for to, keys, logs in ((out.grams, "grams", "logs"), (out.contexts, "contexts", "weights")):
                key = np.frombuffer(b"".join(x[keys] for x in own), np.uint64)
                order = np.argsort(key)
                to[k] = key[order], np.frombuffer(b"".join(x[logs] for x in own), np.float32)[order]
        return out

    def log_probability(self, h: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """h[k]: hashes of the last k symbols; before[k]: of the k symbols before the last."""
        out = np.zeros(len(h[ORDER]), dtype=np.float64)
        open_ = np.arange(len(out))
        for k in range(ORDER, 0, -1):
            keys, logs = self.grams[k]
            if not len(keys):
                continue
            x = h[k][open_]
            i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            hit = keys[i] == x
            out[open_[hit]] += logs[i[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            keys, logs = self.contexts[k]
            x = before[k - 1][open_]
            i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            hit = keys[i] == x
            out[open_[hit]] += logs[i[hit]]
        out[open_] += self.uniform
        return out


class Identifier:
    """Scores texts under all models; what a gram scored is remembered, up to CACHE grams."""

    CACHE = 400_000

    def __init__(self, models: list[Model], cells: np.ndarray | None = None):
        """cells: for each cell whether its places count here; all do without."""
        self.models, self.cells = models, cells
        self.known, self.scores = np.empty(0, np.uint64), np.empty((0, len(models)), dtype=np.float32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The mean negative log probability of a symbol, a row a text and a column a model; and how many symbols are letters.

        With cells, symbols of other cells add nothing to the mean's sum.
        """
        s, ends = symbols(texts)
        inside = _inside(ends)
        at = np.flatnonzero(inside)
        if not len(at):
            return np.zeros((len(texts), len(self.models))), np.zeros(len(texts), dtype=np.int64)
        n = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
        letters = np.zeros(len(texts), dtype=np.int64)
        letters[n > 0] = np.add.reduceat((s[at] != _SPACE).astype(np.int64), (np.cumsum(n) - n)[n > 0])
        whole = np.maximum(n, 1)[:, None]
        if self.cells is not None:
            at = at[self.cells[_cells(s[at - 2], s[at - 1])]]
            n = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
            if not len(at):
                return np.zeros((len(texts), len(self.models))), letters
        h = gram_hashes(s)
        u, first, inverse = distinct(h[ORDER][at])
        place = np.minimum(np.searchsorted(self.known, u), max(0, len(self.known) - 1))
        new = self.known[place] != u if len(self.known) else np.ones(len(u), dtype=bool)
        if new.any():
            p = at[first[new]]
            own, before = [x[p] for x in h], [x[p - 1] for x in h]
            fresh = np.stack([m.log_probability(own, before) for m in self.models], axis=1).astype(np.float32)
            if len(self.known) + len(fresh) > self.CACHE:
                keep = np.unique(place[~new])
                self.known, self.scores = self.known[keep], self.scores[keep]
            both = np.concatenate([self.known, u[new]])
            order = np.argsort(both)
            self.known, self.scores = both[order], np.concatenate([self.scores, fresh])[order]
            place = np.searchsorted(self.known, u)
        full = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[full]
        total = np.zeros((len(texts), len(self.models)))
        total[full] = np.add.reduceat(self.scores[place].take(inverse, axis=0), starts, axis=0, dtype=np.float64)
        return -total / whole, letters


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)).cast("int")


def _statistics(table: pa.Table) -> pa.Table:
    """lang, k, gram, a, b: for orders above LOW how many grams count once and twice, for LOW each gram and its count in these cells."""
    lang, grams = table.column("lang")[0].as_py(), table.column("gram").to_pylist()
    (h, at), n = _hashed(grams), table.column("n").to_numpy()
    out = []
    for k in range(ORDER, LOW, -1):
        out.append((k, "", int((n == 1).sum()), int((n == 2).sum())))
        at, n = _shorter(h, at, k)
    out += [(LOW, grams[i // (ORDER + 1)][-LOW:], int(m), 0) for i, m in zip(at, n)]
    k, gram, a, b = zip(*out)
    return pa.table({"lang": [lang] * len(out), "k": pa.array(k, pa.int32()), "gram": gram, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _part(shared):
    """An Arrow function that builds the orders above LOW of one language's grams in a slot."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, slot = (x.as_py() for x in key)
        discounts, below_h, below_p = shared.value[lang]
        (h, at), n = _hashed(table.column("gram").to_pylist()), table.column("n").to_numpy().astype(np.float64)
        levels = []
        for k in range(ORDER, LOW, -1):
            levels.append(_level(h, at, n, k, discounts[k]))
            at, n = _shorter(h, at, k)
        out = [{"lang": lang, "slot": slot, "k": k, "grams": g.tobytes(), "logs": np.log(p).astype(np.float32).tobytes(), "contexts": ctx.tobytes(), "weights": np.log(w).astype(np.float32).tobytes()} for k, g, p, ctx, w in _interpolated(levels, below_h, below_p)]
        return pa.Table.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("k", pa.int32()), *((x, pa.binary()) for x in ("grams", "logs", "contexts", "weights"))]))

    return run


class Trained:
    """All models as a table of parts; orders up to LOW are held here."""

    def __init__(self, langs: list[str], low: dict[str, Model], parts: DataFrame, slots: int, passes: list[tuple[list[str], list[int]]]):
        self.langs, self.low, self.parts, self.slots, self.passes = langs, low, parts, slots, passes

    def models(self, langs: list[str], slots: list[int]) -> tuple[list[Model], np.ndarray | None]:
        """The models of a pass, and its cells if it hasn't all."""
        rows = self.parts.where(F.col("slot").isin(slots) & F.col("lang").isin(langs)) if len(self.passes) > 1 else self.parts
        by: dict[str, list[dict]] = {x: [] for x in langs}
        for r in rows.toArrow().to_pylist():
            by[r["lang"]].append(r)
        cells = np.isin(np.arange(CELLS) % self.slots, slots) if len(slots) < self.slots else None
        return [self.low[x].extended(by.pop(x)) for x in langs], cells


def train(rows: DataFrame) -> Trained | None:
    """The models of rows (lang, text); None without any gram. What reaches the driver is orders up to LOW and a number a language and slot."""
    counts = written(gram_counts(rows.where("lang is not null and text is not null").select("lang", "text")), "grams")
    totals = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("grams")).collect()
    if not totals:
        return None
    langs = sorted(r["lang"] for r in totals)
    slots = min(CELLS, -(-sum(r["grams"] for r in totals) // SLOT_GRAMS))
    dealt = counts.withColumn("slot", (F.col("cell") % slots).cast("int")).select("lang", "slot", "gram", "n")
    found = dealt.groupBy("lang", "slot").applyInArrow(_statistics, "lang string, k int, gram string, a long, b long")
    discounts: dict[str, dict[int, float]] = {x: {} for x in langs}
    pairs: dict[str, list[tuple[str, int]]] = {x: [] for x in langs}
    for r in found.groupBy("lang", "k", "gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow().to_pylist():
        if r["k"] > LOW:
            discounts[r["lang"]][r["k"]] = _discount(r["a"], r["b"])
        else:
            pairs[r["lang"]].append((r["gram"], r["a"]))
    low = {x: Model([" " * (ORDER - LOW) + g for g, _ in pairs[x]], np.array([n for _, n in pairs.pop(x)]), LOW) for x in langs}
    shared = rows.sparkSession.sparkContext.broadcast({x: (discounts[x], *low[x].top) for x in langs})
    parts = written(dealt.groupBy("lang", "slot").applyInArrow(_part(shared), "lang string, slot int, k int, grams binary, logs binary, contexts binary, weights binary"), "models")
    size = {(r["lang"], r["slot"]): r["n"] for r in parts.where(F.col("k") == ORDER).select("lang", "slot", (F.length("grams") / 8).cast("long").alias("n")).collect()}
    passes: list[tuple[list[str], list[int]]] = []
    for own in (langs[i : i + LANGUAGES] for i in range(0, len(langs), LANGUAGES)):
        held, room = [], 0
        for slot in range(slots):
            n = sum(size.get((x, slot), 0) for x in own)
            if held and room < n:
                passes.append((own, held))
                held = []
            room = (room if held else MODEL_GRAMS) - n
            held.append(slot)
        passes.append((own, held))
    return Trained(langs, low, parts, slots, passes)


def _scorer(shared):
    """(texts) -> mean negative log probabilities of a pass and letters, for whole documents."""
    models, cells = shared.value
    own = Identifier(models, cells)

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [(i, t[k : k + PIECE]) for i, t in enumerate(texts) for k in range(0, max(1, len(t)), PIECE)]
        e, letters = own.entropies([t for _, t in pieces])
        if len(pieces) > len(texts):  # a long text counts each piece by its length
            doc, w = np.array([i for i, _ in pieces]), np.array([max(1, len(t)) for _, t in pieces], dtype=np.float64)
            e = np.stack([np.bincount(doc, weights=e[:, j] * w, minlength=len(texts)) for j in range(e.shape[1])], axis=1) / np.bincount(doc, weights=w, minlength=len(texts))[:, None]
            letters = np.bincount(doc, weights=letters, minlength=len(texts)).astype(np.int64)
        return e, letters

    return run


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows (..., text) in runs of about ROWS characters, with their texts."""
    for b in batches:
        texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= ROWS:
                yield b.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield b.slice(start), texts[start:]


def score(rows: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, fold, lang, letters, best (index of a language), entropy, margin (to the runner-up) of rows (doc_id, fold, lang, text)."""
    sc = rows.sparkSession.sparkContext
    if len(trained.passes) > 1:
        return _score_in_passes(rows, trained)
    shared = sc.broadcast(trained.models(*trained.passes[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entropies = _scorer(shared)
        for part, texts in _in_parts(batches):
            e, letters = entropies(texts)
            best = e.argmin(axis=1)
            two = np.partition(e, 1, axis=1)[:, :2] if e.shape[1] > 1 else np.concatenate([e, e + MARGIN_BINS * BIN], axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(letters), pa.array(best.astype(np.int32)), pa.array(two[:, 0]), pa.array(two[:, 1] - two[:, 0])], names=["doc_id", "fold", "lang", "letters", "best", "entropy", "margin"])

    return rows.select("doc_id", "fold", "lang", "text").mapInArrow(run, "doc_id long, fold int, lang string, letters long, best int, entropy double, margin double")


def _score_in_passes(rows: DataFrame, trained: Trained) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    text = F.coalesce("text", F.lit(""))
    keyed = rows.select("doc_id", "fold", "lang", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(77), text).alias("t2"), text.alias("text"))

    def runner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entropies = _scorer(shared)
            for part, texts in _in_parts(batches):
                e, letters = entropies(texts)
                at = np.arange(0, e.size + 1, e.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(letters), pa.ListArray.from_arrays(pa.array(at), pa.array(e.reshape(-1)))], names=["t1", "t2", "letters", "e"])

        return run

    sums = None
    for i, (langs, slots) in enumerate(trained.passes):
        shared = sc.broadcast(trained.models(langs, slots))
        some = keyed.select("t1", "t2", "text").mapInArrow(runner(shared), "t1 long, t2 long, letters long, e array<double>")
        # equal texts count once; the offset of the pass's languages tells groups apart
        one = written(some.groupBy("t1", "t2").agg(F.first("letters").alias("letters"), F.first("e").alias("e")), "pass").withColumns({"i": F.lit(i), "offset": F.lit(trained.langs.index(langs[0]))})
        shared.destroy()
        sums = one if sums is None else sums.unionByName(one)
    add = lambda x, y: F.when(F.size(x) == 0, y).otherwise(F.zip_with(x, y, lambda p, q: p + q))
    whole = sums.groupBy("t1", "t2", "offset").agg(F.first("letters").alias("letters"), F.array_sort(F.collect_list(F.struct("i", "e"))).alias("all"))
    e = F.aggregate(F.col("all.e"), F.array().cast("array<double>"), add)
    ranked = whole.select("t1", "t2", "letters", F.slice(F.array_sort(F.transform(e, lambda x, j: F.struct(x.alias("e"), (j + F.col("offset")).cast("int").alias("best")))), 1, 2).alias("two"))
    texts = ranked.groupBy("t1", "t2").agg(F.first("letters").alias("letters"), F.array_sort(F.flatten(F.collect_list("two"))).alias("two"))
    first, second = F.col("two")[0], F.try_element_at("two", F.lit(2))
    margin = F.coalesce(second["e"] - first["e"], F.lit(MARGIN_BINS * BIN))
    found = written(texts.select("t1", "t2", "letters", first["best"].alias("best"), first["e"].alias("entropy"), margin.alias("margin")), "texts")
    return keyed.drop("text").join(found, ["t1", "t2"]).drop("t1", "t2")


def monotone(right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing shares by pooling neighbours that fall; each bin starts with one right of two, so none is certain."""
    blocks: list[list[float]] = []
    for r, m in zip(right + 1.0, n + 2.0):
        blocks.append([r, m, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            r2, m2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r2, blocks[-1][1] + m2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), r / m) for r, m, k in blocks])


def calibrate(scored: DataFrame, langs: list[str]) -> tuple[list[float], list[float]]:
    """Score of each margin bin; highest entropy of each language. What is collected is a row a bin and language."""
    names = F.array(*[F.lit(x) for x in langs])
    held = scored.where((F.col("fold") == CALIBRATION) & (F.col("letters") > 0) & F.col("lang").isNotNull())
    ok = F.element_at(names, F.col("best") + 1) == F.col("lang")
    at = F.least(F.floor(F.col("margin") / BIN), F.lit(MARGIN_BINS - 1)).cast("int")
    right, n = np.zeros(MARGIN_BINS), np.zeros(MARGIN_BINS)
    for r in held.groupBy(at.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("right")).collect():
        right[r["k"]], n[r["k"]] = r["right"], r["n"]
    limits = [math.inf] * len(langs)
    for r in held.where(ok).groupBy("best").agg(F.percentile_approx("entropy", 1 - TAIL, 10_000).alias("limit")).collect():
        limits[r["best"]] = r["limit"]
    return monotone(right, n).tolist(), limits


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected of every document; learned from the folds other than 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold_of(id_col).alias("fold"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    held_out = (F.col("fold") == 0).alias("held_out")
    trained = train(rows.where(~F.col("fold").isin(0, CALIBRATION)))
    if trained is None:
        return rows.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("rejected"))
    langs = trained.langs
    scored = written(score(rows, trained), "scored")
    table, limits = calibrate(scored, langs)
    none = F.col("letters") == 0
    at = F.least(F.floor(F.col("margin") / BIN), F.lit(MARGIN_BINS - 1)).cast("int") + 1
    value = F.element_at(F.array(*[F.lit(x) for x in table]), at)
    over = F.col("entropy") > F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("best") + 1)
    pred = F.when(none, "und").otherwise(F.element_at(F.array(*[F.lit(x) for x in langs]), F.col("best") + 1))
    return scored.select("doc_id", held_out, pred.alias("lang_pred"), F.when(none, 0.0).otherwise(value).alias("score"), F.when(~none, F.col("entropy")).alias("entropy"), (~none & (over | (value < 0.5))).alias("rejected"))
