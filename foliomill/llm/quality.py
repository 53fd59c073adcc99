"""Quality rules whose cutoffs are risk-controlled: DataFrame functions only.

Each rule rejects a document whose value lies above a cutoff. The cutoffs of all rules are tightened together, along the steps of one fixed
grid: a document's step is the highest that one of its values reaches. Labelled good documents are a holdout: for every stratum the steps are
tested from the loosest to the strictest, and the last is taken for which the exact binomial test still shows that all rules together
lose at most `limit` of the good documents. Testing in a fixed order needs no correction within a grid. Over strata the error `delta` is
shared out evenly (Bonferroni) among those that hold enough labelled documents to pass at all, which their number alone decides; so
with probability 1 - delta all limits hold at once. A stratum without evidence gets no cutoff and only the base rules reject there.

Scale. One pass over the texts without a shuffle; of labelled documents only counts by stratum and step are collected, 201 rows a stratum.

Defined cases: a null text has no words; an empty table gives an empty table; a null stratum is a stratum of its own; a document labelled
both ways is left out of the holdout, one labelled twice alike counts once; strata with equal numbers of labels fare alike; repeated rows are
judged alike; documents of any length are judged whole; other columns of the input are ignored or kept, never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, without, word_count, words, written

#: The base rules: fewest words, and the largest percentage of repeated words.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Of good documents the rules may lose so many in a stratum; the chance that any limit is broken.
LIMIT, DELTA = 0.01, 0.05
#: Rule: lowest cutoff, highest cutoff. Cutoffs lie on GRID equal steps between them.
RULES = {
    "symbol_share": (0.0, 0.5),
    "dup_line_share": (0.0, 1.0),
    "repeat_share": (0.0, 0.5),
    "mean_word_chars": (4.0, 24.0),
    "upper_share": (0.0, 1.0),
    "bang_share": (0.0, 0.5),
}
GRID = 200
#: Cutoffs are broadcast up to so many rows (strata times rules), joined by a shuffle beyond.
BROADCAST_ROWS = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def dup_lines(text: Column) -> tuple[Column, Column]:
    """Lines with a word, and those of them that are equal to an earlier one, as one struct (lines, dups)."""
    full = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return bound(full, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups")))


def repeat_words(text: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are sorted by hash with their place, so equal ones are neighbours: n log n for n words, within the row.
    """

    def of_windows(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        places = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound(F.sort_array(places), of_sorted))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(bound(hashes, of_windows))

    return bound(words(text), of_words).cast("long")


def features(docs: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stratum, the base counts, base_failed and a value for each rule. One pass, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum).alias("stratum"),
        word_count(F.col(text_col)).alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        count_chars(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        dup_lines(text).alias("lines"),
        repeat_words(text).alias("n_repeat_words"),
        count_chars(text, UPPER).alias("upper"),
        count_chars(text, "!?").alias("bangs"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return base.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", F.col("lines.dups").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        (F.col("lines.dups") / F.greatest(F.col("lines.lines"), F.lit(1))).alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("upper", "word_chars").alias("upper_share"),
        share("bangs", "word_chars").alias("bang_share"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed in logarithms; 1 where k is at least n * p, as no test is passed there."""
    first, odds = n * math.log1p(-p), math.log(p / (1 - p))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (F.greatest(acc["s"], t) + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s"))

    terms = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("t"), first.alias("s")), step, lambda acc: F.exp(acc["s"]))
    return F.when(k >= n * p, 1.0).when(k == 0, F.exp(first)).otherwise(terms)


def cutoffs(feats: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, lost, n: the strictest cutoffs of each stratum that the holdout certifies; lost and n are those of all rules.

    Good documents are counted by stratum and grid step before anything is shuffled, so a hot stratum is a few rows.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = 1 and hi = 1").select("doc_id")
    held = feats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    step = lambda r: F.least(F.greatest(F.ceil((F.col(r) - RULES[r][0]) / ((RULES[r][1] - RULES[r][0]) / GRID)), F.lit(0)), F.lit(GRID)).cast("int")
    counted = held.groupBy("stratum", F.greatest(*[step(r) for r in RULES]).alias("step")).agg(F.count(F.lit(1)).alias("docs"))
    per = counted.groupBy("stratum").agg(F.sum("docs").alias("n"), F.collect_list(F.struct("step", "docs")).alias("hist"))
    # one row a stratum: those that could pass without any loss share delta
    able = F.col("n") * math.log1p(-limit) <= F.log(delta / F.row_number().over(Window.orderBy(F.col("n").desc())))
    per = per.withColumn("able", able).withColumn("share", F.sum(F.col("able").cast("long")).over(Window.partitionBy())).where("able")
    # a cutoff at step c loses the documents of higher steps
    grid = per.select("stratum", "n", "hist", "share", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("c"))
    lost = F.aggregate(F.filter("hist", lambda x: x["step"] > F.col("c")), F.lit(0).cast("long"), lambda a, x: a + x["docs"])
    passed = grid.select("stratum", "n", "share", "c", lost.alias("lost")).where(binomial_tail(F.col("lost"), F.col("n"), limit) <= delta / F.col("share"))
    best = passed.groupBy("stratum", "n").agg(F.min(F.struct("c", "lost")).alias("best"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), (lo + F.col("best.c") * ((hi - lo) / GRID)).alias("cutoff")) for r, (lo, hi) in RULES.items()]))
    return best.select("stratum", "n", F.col("best.lost").alias("lost"), each.alias("x")).select("stratum", "x.rule", "x.cutoff", "lost", "n")


def judge(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """feats with kept and failed_rules; cuts as cutoffs() gives them."""
    one = cuts.groupBy(F.col("stratum").alias("cut_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    one = written(one, "cutoffs")
    if one.count() * len(RULES) <= BROADCAST_ROWS:
        one = F.broadcast(one)
    joined = feats.join(one, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}") + 1e-12, F.lit(r)) for r in RULES]))
    return joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def assess(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules of every document."""
    feats = written(features(docs, stratum), "features")
    return judge(feats, cutoffs(feats, labels, limit, delta)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def keep_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with their own columns; rows that share an id stay if one of them is kept."""
    judged = assess(docs, labels, **options)
    return without(docs, judged.groupBy("doc_id").agg(F.max("kept").alias("any")).where(~F.col("any")).select("doc_id"))
