"""String functions over lines and units, and golden rows for those that SQL can't express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.functions import text as t
from foliomill.plans.registry import operator

# Fixed cases of the punctuation normaliser.
FULL_WIDTH_CASES = (
    ("螺栓按图拧紧, 然后复查;", "螺栓按图拧紧，然后复查；"),
    ("额定压力 12,750 磅", "额定压力 12,750 磅"),
    ("厚度取 0.25 毫米", "厚度取 0.25 毫米"),
    ("如 Tab. 3-2 中所列", "如 Tab. 3-2 中所列"),
    ("零件 QK7.5512B 已停产", "零件 QK7.5512B 已停产"),
    ("长度 110-125 毫米", "长度 110-125 毫米"),
    ("检查时间 14:05:30 开始", "检查时间 14:05:30 开始"),
    ("注意(参看下页)", "注意（参看下页）"),
    ("Plain Latin text, left alone;", "Plain Latin text, left alone;"),
    ("到此为止.", "到此为止。"),
    ("<i>斜体</i>, 标签不动", "<i>斜体</i>，标签不动"),
    ("网址 www.sample.org, 可供查询", "网址 www.sample.org，可供查询"),
    ("见 https://sample.org/q?n=2, 另有说明", "见 https://sample.org/q?n=2，另有说明"),
    ("油量 3/4 满, 液位 CO<sub>2</sub> 正常", "油量 3/4 满，液位 CO<sub>2</sub> 正常"),
    ("左 , 右", "左，右"),
)
COLLAPSE_CASES = (("A A", "A"), ("A B B", "A B"), ("A B A B", "A B"), ("A A A A", "A"), ("A B C", "A B C"), ("x  y", "x  y"))
WRAP_CASES = (("中文字符，测试", 4.0, ["中文字符，", "测试"]), ("（甲）乙丙丁", 3.0, ["（甲）", "乙丙丁"]), ("abc defg", 3.0, ["abc", "defg"]), ("", 3.0, []), ("甲乙（丙", 3.0, ["甲乙", "（丙"]))


def values(rows) -> str:
    q = lambda x: "[" + ", ".join(map(q, x)) + "]" if isinstance(x, (list, tuple)) else str(x) if isinstance(x, float) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


@operator("T2 Q01", f"SELECT input, output, true AS stable FROM (VALUES {values(FULL_WIDTH_CASES)}) x(input, output)")
def full_width_cases(v):
    """Punctuation normalised, and whether doing it twice changes nothing."""
    d = v.spark.createDataFrame([(a,) for a, _ in FULL_WIDTH_CASES], "input string").withColumn("output", t.full_width_udf("input"))
    return d.withColumn("stable", t.full_width_udf("output") == F.col("output"))


@operator("T2", """SELECT doc_id, line_no, CASE WHEN k = 3 THEN '表 ' || CASE WHEN w = '' THEN 'item' ELSE w END || '，时间 9:52；值 1,500！（完）' ELSE replace(replace(replace(text, chr(160), ' '), chr(8209), '-'), chr(173), '') END AS text FROM (SELECT s.doc_id, s.line_no, s.k, s.text, regexp_extract(string_split(d.text, chr(10))[s.line_no + 1], '[A-Za-z]+') AS w FROM st s JOIN documents d ON d.doc_id = s.doc_id) WHERE k <> 8""")
def full_width_lines(v):
    """The normaliser over all lines; only those with Han characters go to Python, others just lose their look-alike characters."""
    plain = F.replace(F.translate("text", "\u00a0\u2011", " -"), F.lit("\u00ad"), F.lit(""))
    han = F.col("text").rlike("[一-鿿]")
    return v.st.where("k <> 8").select("doc_id", "line_no", F.when(han, t.full_width_udf(F.when(han, F.col("text")))).otherwise(plain).alias("text"))


@operator("T7", f"SELECT * FROM (VALUES {values(COLLAPSE_CASES)}) x(input, output)")
def collapse_cases(v):
    """Repeated word sequences collapsed."""
    return v.spark.createDataFrame([(a,) for a, _ in COLLAPSE_CASES], "input string").withColumn("output", t.collapse_repeats_udf("input"))


@operator("T18 T22 T23", f"SELECT input, lines FROM (VALUES {values([(a, c) for a, _, c in WRAP_CASES if c])}) x(input, lines) UNION ALL SELECT '', CAST([] AS VARCHAR[])")
def wrap_cases(v):
    """Lines wrapped by width with marks kept off line ends."""
    d = v.spark.createDataFrame([(a, w) for a, w, _ in WRAP_CASES], "input string, width double")
    return d.select("input", t.wrap_udf("input", "width").alias("lines"))



@operator("T17 T19 T24", r"""SELECT doc_id, line_no, round(w * size, 4) AS width, CAST(ceil(w * size / 160) AS BIGINT) AS n_lines, regexp_matches(text, '[一-鿿\x{FF01}-\x{FF5E}\x{3000}-\x{303F}]') AS chinese FROM (SELECT *, 0.55 * length(regexp_replace(text, '[^\x{0}-\x{2E80}]', '', 'g')) + 1.0 * length(regexp_replace(text, '[\x{0}-\x{2E80}]', '', 'g')) AS w FROM st)""")
def line_widths(v):
    """Estimated widths of lines (1 em a wide character, 0.55 else), the lines they take in 160 points, and whether they are Chinese."""
    wide = F.length(F.regexp_replace("text", r"[\x{0}-\x{2E80}]", ""))
    w = (55 * (F.length("text") - wide) + 100 * wide) / F.lit(100.0)  # in hundredths, so that no sum is rounded
    return v.st.select("doc_id", "line_no", F.round(w * F.col("size"), 4).alias("width"), F.ceil(w * F.col("size") / 160).alias("n_lines"), F.col("text").rlike(r"[一-鿿\x{FF01}-\x{FF5E}\x{3000}-\x{303F}]").alias("chinese"))


@operator("T29", r"""SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '^第\s*[0-9ivx]+\s*页') THEN 'page' WHEN regexp_matches(text, '附录\s*[A-Z]-[0-9]') THEN 'appendix' WHEN regexp_matches(text, '^[(（][ivx]+[)）]') THEN 'roman' END AS form, label FROM (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN '第 ' || (line_no + 1) || ' 页 / 共 9 页' WHEN 1 THEN '附录 A-' || line_no WHEN 2 THEN '（' || ['i', 'ii', 'iv', 'x'][doc_id % 4 + 1] || '） ' || text ELSE text END AS label, CASE line_no % 4 WHEN 0 THEN '第 ' || (line_no + 1) || ' 页 / 共 9 页' WHEN 1 THEN '附录 A-' || line_no WHEN 2 THEN '（' || ['i', 'ii', 'iv', 'x'][doc_id % 4 + 1] || '） ' || text ELSE text END AS text FROM st WHERE k = 2 OR k = 19)""")
def label_forms(v):
    """Which form of page label a line has: Chinese, of an appendix, or roman in brackets."""
    s, n = v.st.where("k = 2 OR k = 19"), F.col("line_no").cast("string")
    roman = F.element_at(F.array(*[F.lit(r) for r in ("i", "ii", "iv", "x")]), (F.col("doc_id") % 4 + 1).cast("int"))
    k = F.col("line_no") % 4
    label = F.when(k == 0, F.concat(F.lit("第 "), (F.col("line_no") + 1).cast("string"), F.lit(" 页 / 共 9 页"))).when(k == 1, F.concat(F.lit("附录 A-"), n)).when(k == 2, F.concat(F.lit("（"), roman, F.lit("） "), "text")).otherwise(F.col("text"))
    t = s.select("doc_id", "line_no", label.alias("label"))
    return t.select("doc_id", "line_no", F.when(F.col("label").rlike(r"^第\s*[0-9ivx]+\s*页"), "page").when(F.col("label").rlike(r"附录\s*[A-Z]-[0-9]"), "appendix").when(F.col("label").rlike(r"^[(（][ivx]+[)）]"), "roman").alias("form"), "label")


@operator("T8", r"""SELECT doc_id, first AS line_no, CASE WHEN n = 2 THEN trim(regexp_replace(trim(regexp_replace(a, '\.{3,}\s*$', ' ')) || ' ' || trim(regexp_replace(b, '^\s*\.{3,}', '')), '\s+', ' ', 'g')) ELSE a END AS text FROM (SELECT doc_id, min(line_no) AS first, count(*) AS n, arg_min(text, line_no) AS a, arg_max(text, line_no) AS b FROM (SELECT *, CASE WHEN joined THEN line_no - 1 ELSE line_no END AS head FROM (SELECT *, link AND (line_no - isle) % 2 = 1 AS joined FROM (SELECT *, max(CASE WHEN NOT link THEN line_no END) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS isle FROM (SELECT doc_id, page, line_no, text, coalesce(regexp_matches(lag(text) OVER (PARTITION BY doc_id, page ORDER BY line_no), '\.{3,}\s*$') AND regexp_matches(text, '^\s*\.{3,}'), false) AS link FROM st)))) GROUP BY doc_id, head)""")
def joined_leaders(v):
    """Contents rows whose leader was broken over two lines, joined pairwise: each line joins one other at most, from the top."""
    o = Window.partitionBy("doc_id", "page").orderBy("line_no")
    link = F.coalesce(F.lag("text").over(o).rlike(r"\.{3,}\s*$") & F.col("text").rlike(r"^\s*\.{3,}"), F.lit(False))
    s = v.st.select("doc_id", "page", "line_no", "text", link.alias("link"))
    # in a run of links every other one joins
    s = s.withColumn("isle", F.max(F.when(~F.col("link"), F.col("line_no"))).over(o)).withColumn("joined", F.col("link") & ((F.col("line_no") - F.col("isle")) % 2 == 1))
    g = s.groupBy("doc_id", F.when(F.col("joined"), F.col("line_no") - 1).otherwise(F.col("line_no")).alias("head")).agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"), F.min_by("text", "line_no").alias("a"), F.max_by("text", "line_no").alias("b"))
    both = F.concat_ws(" ", F.trim(F.regexp_replace("a", r"\.{3,}\s*$", " ")), F.trim(F.regexp_replace("b", r"^\s*\.{3,}", "")))
    return g.select("doc_id", "line_no", F.when(F.col("n") == 2, F.trim(F.regexp_replace(both, r"\s+", " "))).otherwise(F.col("a")).alias("text"))


@operator("T9 T10")
def cleaned_lines(v):
    """Lines of a page made whole: broken leaders and wrapped lines joined, symbols and leaders normalised, repeated words collapsed."""
    schema = "doc_id long, line_no long, text string, x0 double, y0 double, x1 double, y1 double"
    return v.st.where("trim(text) <> ''").select("doc_id", "page", "line_no", "text", "size", "x0", "y0", "x1", "y1").groupBy("doc_id", "page").applyInPandas(t.clean_page, schema)


@operator("T1 T6 T12 T14 T15 T16 T21 T27", r"""SELECT doc_id, line_no, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal, trim(regexp_replace(regexp_replace(text, '\.{3,}', ' … ', 'g'), '\s+', ' ', 'g')) AS leaders, trim(text, '.,;:()[]') AS stripped, regexp_replace(text, '\s', '', 'g') AS joined,
  CASE WHEN regexp_matches(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '^[0-9]') THEN 'd' ELSE '' END || lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS ident, replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&amp;', '&') AS plain,
  regexp_matches(text, '^[,.;:!?)]') AS bad_head, regexp_matches(text, '[(\[]$') AS bad_tail, sha256(text) AS sha FROM ln""", big="line_no")
def text_functions(v):
    """The scalar text functions over all lines."""
    c = F.col("text")
    ident = F.regexp_replace(c, "[^A-Za-z0-9]+", "_")
    norm = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return v.ln.select(
        "doc_id", "line_no", norm(c).alias("normal"), norm(F.regexp_replace(c, r"\.{3,}", " … ")).alias("leaders"), F.trim(c, F.lit(".,;:()[]")).alias("stripped"), F.regexp_replace(c, r"\s", "").alias("joined"),
        F.concat(F.when(ident.rlike("^[0-9]"), "d").otherwise(""), F.lower(F.trim(ident, F.lit("_")))).alias("ident"), F.replace(F.regexp_replace(c, "<[^>]*>", ""), F.lit("&amp;"), F.lit("&")).alias("plain"),
        c.rlike("^[,.;:!?)]").alias("bad_head"), c.rlike(r"[(\[]$").alias("bad_tail"), F.sha2(c, 256).alias("sha"),
    )


@operator("T3 T4 T20 T25 Y17", r"""SELECT l_orderkey, rid, regexp_extract_all(s, '[0-9]+-[0-9]+/[0-9]+|[0-9]{5,}|[0-9]+(?:\.[0-9]+)? ?(?:psi|mm)') AS atoms, regexp_replace(s, '<sub>([0-9]+)</sub>', '_\1', 'g') AS subs, regexp_replace(s, '(^|[^0-9])\.([0-9])', '\10.\2', 'g') AS zeros, s || repeat('.', CAST(greatest(0, 60 - length(s)) AS INTEGER)) AS led
  FROM (SELECT page_key AS l_orderkey, rid, 'H<sub>' || size || '</sub> ' || size || '-' || l_linenumber || '/8 part ' || (l_partkey + 10000) || ' .' || l_linenumber || ' at ' || size || ' psi' AS s FROM rc)""")
def unit_texts(v):
    """Atoms, subscripts, leading zeros and leader dots of composed texts."""
    x = lambda c: F.col(c).cast("string")
    s = v.rc.select(F.col("page_key").alias("l_orderkey"), "rid", F.concat(F.lit("H<sub>"), x("size"), F.lit("</sub> "), x("size"), F.lit("-"), x("l_linenumber"), F.lit("/8 part "), (F.col("l_partkey") + 10000).cast("string"), F.lit(" ."), x("l_linenumber"), F.lit(" at "), x("size"), F.lit(" psi")).alias("s"))
    return s.select("l_orderkey", "rid", F.regexp_extract_all("s", F.lit(r"[0-9]+-[0-9]+/[0-9]+|[0-9]{5,}|[0-9]+(?:\.[0-9]+)? ?(?:psi|mm)"), 0).alias("atoms"), F.regexp_replace("s", "<sub>([0-9]+)</sub>", "_$1").alias("subs"), F.regexp_replace("s", r"(^|[^0-9])\.([0-9])", "$10.$2").alias("zeros"), F.concat("s", F.repeat(F.lit("."), F.greatest(F.lit(0), 60 - F.length("s")))).alias("led"))
