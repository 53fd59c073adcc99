"""Queries of the operators, as registered in __spark_entry__.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, jaccard, langid, mixing, pii, quality, quotes, sharding, simhash, token_table
from .common import read_table

ONE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MANY_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SHARDS = {f"shard-{k:05d}": 1 for k in range(256)}


def op1_token_table(spark, sf_dir):
    return token_table.encode_and_digest(read_table(spark, sf_dir, "documents"), ONE_VOCABULARY, public_tokenizers.PATTERN)


def op2_kneser_ney(spark, sf_dir):
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op3_quotation_links(spark, sf_dir):
    return quotes.reply_order(read_table(spark, sf_dir, "conversations"))


def quoted_messages(spark, sf_dir):
    """The conversations as mail would hold them: each message quotes the one before it, and at a second level the one before that."""
    own = read_table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    before = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("p1"))
    further = own.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("p2"))
    all_three = own.join(before, ["conv_id", "turn"], "left").join(further, ["conv_id", "turn"], "left")
    level = lambda c, mark: F.concat(F.lit(mark), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + mark)))
    quotes_ = F.concat(level("p1", "> "), F.coalesce(F.concat(F.lit("\n"), level("p2", ">> ")), F.lit("")), F.lit("\n\n"))
    return all_three.select("conv_id", "turn", "role", F.concat(F.coalesce(quotes_, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def op3_quoted_threads(spark, sf_dir):
    return quotes.reply_order(quoted_messages(spark, sf_dir))


def op4_simhash(spark, sf_dir):
    return simhash.near_counts(simhash.edited_likeness(read_table(spark, sf_dir, "documents")))


def op5_signature_trees(spark, sf_dir):
    return jaccard.similar_components(read_table(spark, sf_dir, "documents"))


def op5_link_counts(spark, sf_dir):
    return jaccard.link_counts(read_table(spark, sf_dir, "documents"))


def op6_risk_controlled_rules(spark, sf_dir):
    return quality.assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_sainte_lague_mix(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_weak_supervision(spark, sf_dir):
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op9_two_tier_bpe(spark, sf_dir):
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), MANY_VOCABULARY, public_tokenizers.PATTERN)


def op10_permutation_table(spark, sf_dir):
    return sharding.place(read_table(spark, sf_dir, "documents"), ["doc_id"], sharding.build_table(SHARDS))


QUERIES = {f.__name__: f for f in (op1_token_table, op2_kneser_ney, op3_quotation_links, op4_simhash, op5_signature_trees, op6_risk_controlled_rules, op7_sainte_lague_mix, op8_weak_supervision, op9_two_tier_bpe, op10_permutation_table, op5_link_counts, op3_quoted_threads)}

WORD = r"[^\x20\x09-\x0D]+"

OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) c ON c.u = d.doc_id
"""

OP5_LINKS_SQL = OP5_SQL.replace("AS component_id", "AS component_id, coalesce(k.k, 0) AS n_links") + "LEFT JOIN (SELECT u, count(*) AS k FROM e GROUP BY u) k ON k.u = d.doc_id"


_NORMAL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

OP3_SQL = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT DISTINCT conv_id, turn, {_NORMAL.format("x")} AS unit FROM (SELECT conv_id, turn, unnest([text] || regexp_split_to_array(text, '\n\s*\n') || string_split(text, chr(10)) || string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS x FROM m)),
f AS (SELECT conv_id, unit, min(turn) AS original FROM u GROUP BY conv_id, unit),
q AS (SELECT a.conv_id, a.turn, a.role, a.text, nullif({_NORMAL.format("b.text")}, '') AS q1, nullif({_NORMAL.format("c.text")}, '') AS q2 FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN m c ON b.turn IS NOT NULL AND c.conv_id = a.conv_id AND c.turn = a.turn - 2),
p AS (SELECT q.*, coalesce(x.original, y.original) AS parent_turn FROM q LEFT JOIN f x ON x.conv_id = q.conv_id AND x.unit = q1 LEFT JOIN f y ON y.conv_id = q.conv_id AND y.unit = q2),
t AS (SELECT conv_id, turn, turn AS thread FROM p WHERE parent_turn IS NULL UNION ALL SELECT p.conv_id, p.turn, t.thread FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.parent_turn)
SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY thread, p.turn) - 1 AS position, p.turn, role, parent_turn, thread,
  CAST(q1 IS NOT NULL AS BIGINT) + CAST(q2 IS NOT NULL AS BIGINT) AS n_quotes, CAST(q1 IS NOT NULL AS BIGINT) + CAST(q2 IS NOT NULL AS BIGINT) AS n_linked,
  trim(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS text
FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn
"""


def _op6_sql() -> str:
    rules = quality.RULES
    p, g = quality.LIMIT, quality.GRID
    step = lambda r, lo, hi: f"least(greatest(ceil(({r} - {lo}::DOUBLE) / {(hi - lo) / g!r}::DOUBLE), 0), {g})"
    cut = lambda r, lo, hi: f"{lo}::DOUBLE + c * {(hi - lo) / g!r}::DOUBLE AS cut_{r}"
    failed = ", ".join(f"CASE WHEN {r} > cut_{r} + 1e-12 THEN '{r}' END" for r in rules)
    return f"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT doc_id, stratum, t, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT doc_id, stratum, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
  n_symbols / greatest(word_chars, 1) AS symbol_share, (len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS mean_word_chars,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) / greatest(word_chars, 1) AS upper_share, (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) / greatest(word_chars, 1) AS bang_share FROM b),
held AS (SELECT * FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1)),
steps AS (SELECT stratum, greatest({", ".join(step(r, lo, hi) for r, (lo, hi) in rules.items())}) AS step FROM held),
able AS (SELECT stratum, count(*) OVER () AS share FROM (SELECT stratum, n, row_number() OVER (ORDER BY n DESC) AS place FROM (SELECT stratum, count(*) AS n FROM steps GROUP BY stratum)) WHERE n * ln(1 - {p}) <= ln({quality.DELTA} / place)),
grid AS (SELECT s.stratum, share, c, count(*) AS n, count(*) FILTER (WHERE step > c) AS lost FROM steps s JOIN able a ON s.stratum IS NOT DISTINCT FROM a.stratum, (SELECT unnest(range(0, {g})) AS c) GROUP BY s.stratum, share, c),
best AS (SELECT stratum, min(c) AS c FROM grid WHERE lost < n * {p} AND list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) <= {quality.DELTA} / share GROUP BY stratum),
cuts AS (SELECT stratum AS cut_stratum, {", ".join(cut(r, lo, hi) for r, (lo, hi) in rules.items())} FROM best)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed_rules) = 0 AS kept, failed_rules
FROM (SELECT *, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed_rules FROM f LEFT JOIN cuts ON stratum IS NOT DISTINCT FROM cut_stratum)
"""


def _op7_sql() -> str:
    m = mixing
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '(null)')"
    number = lambda seed, *cols: f"CAST('0x' || substr(md5('{seed}:' || {" || ':' || ".join(map(text, cols))}), 1, 8) AS BIGINT)"
    return f"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
per AS (SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS source_size, CAST({list(m.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(m.WEIGHTS)} + 1] AS DOUBLE) AS weight FROM sizes GROUP BY source),
lev AS (SELECT *, CAST({m.MOST} * source_size AS DOUBLE) AS cap, (sum(source_size) OVER () - coalesce(sum({m.MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per WINDOW o AS (ORDER BY {m.MOST} * source_size / weight, source NULLS LAST)),
goal AS (SELECT source, docs, source_size, CASE WHEN cap < level * weight THEN cap ELSE least(cap, coalesce(max(CASE WHEN NOT cap < level * weight THEN level END) OVER (), 0) * weight) END AS target FROM lev),
rows_ AS (SELECT doc_id, s.source, size, source_size, target, {number(m.SEED, "doc_id")} % CAST(ceil(docs / {m.SHARD_ROWS}) AS BIGINT) AS shard FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
cells AS (SELECT source, shard, source_size, target, CAST(sum(size) AS BIGINT) AS cell_size, CASE WHEN sum(size) > 0 THEN CAST(greatest(round(sum(size) / {m.BLOCK}), 1) AS BIGINT) ELSE 0 END AS blocks FROM rows_ GROUP BY source, shard, source_size, target),
src AS (SELECT *, CAST(round(sum(wish) OVER ()) AS BIGINT) AS seats FROM (SELECT source, CAST(sum(blocks) AS BIGINT) AS sb, CASE WHEN source_size > 0 THEN target * sum(blocks) / source_size ELSE 0 END AS wish FROM cells GROUP BY source, source_size, target)),
sq AS (SELECT source, least(count(*) FILTER (WHERE rk <= seats), {m.MOST} * max(sb)) AS quota FROM (SELECT *, row_number() OVER (ORDER BY wish / (2 * k + 1) DESC, source NULLS LAST) AS rk FROM (SELECT *, unnest(range(0, CAST(2 * ceil(wish) + 3 AS BIGINT))) AS k FROM src) WHERE wish > 0) GROUP BY source),
cq AS (SELECT source, shard, least(count(*) FILTER (WHERE rk <= quota), {m.MOST} * max(blocks)) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY blocks / (2 * k + 1) DESC, shard) AS rk FROM (SELECT c.*, q.quota, unnest(range(0, {m.MOST} * blocks + 2)) AS k FROM cells c JOIN sq q ON c.source IS NOT DISTINCT FROM q.source) WHERE blocks > 0) GROUP BY source, shard),
runs AS (SELECT c.source, c.shard, cell_size, greatest(blocks, 1) AS n, coalesce(quota, 0) AS quota, {number(m.SEED + 1, "c.source", "c.shard")} % greatest(blocks, 1) AS start FROM cells c LEFT JOIN cq ON c.source IS NOT DISTINCT FROM cq.source AND c.shard = cq.shard),
placed AS (SELECT *, b - size AS a FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY md5('{m.SEED + 2}:' || {text("doc_id")}), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM rows_))
SELECT doc_id, size, source_size, target, CAST(floor(quota / n) * size + greatest(least(b, floor(least(start + quota % n, n) * cell_size / n)) - greatest(a, floor(start * cell_size / n)), 0) + greatest(least(b, floor(greatest(start + quota % n - n, 0) * cell_size / n)) - a, 0) AS BIGINT) AS taken
FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND p.shard = r.shard
"""


ORACLES: dict[str, str] = {"op5_signature_trees": OP5_SQL.strip(), "op5_link_counts": OP5_LINKS_SQL.strip(), "op3_quoted_threads": OP3_SQL.strip(), "op6_risk_controlled_rules": _op6_sql().strip(), "op7_sainte_lague_mix": _op7_sql().strip()}
