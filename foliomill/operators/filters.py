"""Predicates on units, lines, cells and drawings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.operators.scans import kept
from foliomill.plans.registry import operator

KEEP_SQL = "(regexp_full_match(text, '[0-9[:punct:]\\s]*') OR (regexp_full_match(text, '[A-Z0-9][A-Z0-9./-]*') AND regexp_matches(text, '[0-9]')) OR regexp_full_match(text, '[0-9]+/[0-9]+') OR NOT regexp_matches(text, '[A-Za-z]{2}'))"
# Fixed list of words that make no prose: units and operators.
TECHNICAL = ("mm", "cm", "m", "in", "ft", "psi", "ksi", "bar", "mpa", "gpm", "lpm", "rpm", "lb", "lbs", "lbf", "klbs", "kg", "kgf", "nm", "ft-lbs", "ppg", "hp", "kw", "deg", "od", "id", "reg", "if", "fh", "api", "rp", "max", "min", "ref", "typ", "x", "+", "-", "=", "of", "to")
#: The letters of which the derived texts have none, so that residue can be told from translated text.
CJK = "[\\u2E80-\\u9FFF\\uFF00-\\uFFEF]"


@operator("F1 F2 Y10", f"SELECT text, count(*) AS n, {KEEP_SQL} AS kept FROM un GROUP BY text")
def keep_filter(v):
    """Distinct units and whether they stay untranslated."""
    return v.un.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", kept("text"))


@operator("F3 F4 R2", f"""SELECT doc_id, line_no FROM ln WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3 AND NOT regexp_matches(text, '[一-鿿]') AND NOT regexp_matches(text, '^Licensed')
  AND NOT (len(list_filter(string_split(trim(text, ' '), ' '), lambda t: NOT (regexp_full_match(t, '[0-9.,/-]+') OR regexp_full_match(t, '[A-Z]{{1,2}}') OR lower(t) IN {TECHNICAL}))) = 0)""")
def residual_english(v):
    """Lines with Latin words left that are neither white-listed nor only technical tokens."""
    technical = F.forall(F.split(F.trim("text"), " "), lambda t: t.rlike("^[0-9.,/-]+$") | t.rlike("^[A-Z]{1,2}$") | F.lower(t).isin(*TECHNICAL))
    latin = F.length(F.regexp_replace("text", "[^A-Za-z]", "")) >= 3
    return v.ln.where(latin & ~F.col("text").rlike(r"[一-鿿]") & ~F.col("text").rlike("^Licensed") & ~technical).select("doc_id", "line_no")



@operator("F6 A1", "SELECT page_key, count(*) AS cells, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS filled FROM rc GROUP BY page_key HAVING count(*) FILTER (WHERE l_linenumber % 3 = 0) < 4 OR count(*) FILTER (WHERE l_linenumber % 3 = 0) < 0.15 * count(*)")
def fake_tables(v):
    """Grids with fewer than four filled cells, or under 15 % of them."""
    g = v.rc.groupBy("page_key").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("l_linenumber") % 3 == 0).alias("filled"))
    return g.where("filled < 4 OR filled < 0.15 * cells")


KIND = "CASE WHEN fill = 'white' AND x1 - x0 > 200 AND y1 - y0 > 100 THEN 'canvas' WHEN x1 - x0 >= 0.8 * 612 AND y1 - y0 >= 0.2 * 792 THEN 'frame' WHEN fill = 'black' AND x1 - x0 <= 3 AND y1 - y0 >= 10 THEN 'bar' WHEN fill = 'none' AND y1 - y0 BETWEEN 12 AND 20 AND x1 - x0 > 300 THEN 'highlight' ELSE 'art' END"


@operator("F7", f"SELECT doc_id, page, did, {KIND} AS kind FROM dw")
def drawing_kinds(v):
    """Drawings by fill and shape: white canvas, page frame, revision bar, highlight or art."""
    return v.dw.select("doc_id", "page", "did", F.expr(KIND).alias("kind"))


@operator("Q19", f"SELECT d.doc_id, d.page, d.did FROM dw d JOIN (SELECT doc_id, page, max(x1) AS edge FROM dw WHERE {KIND} = 'frame' GROUP BY ALL) f ON f.doc_id = d.doc_id AND f.page = d.page WHERE d.x1 - d.x0 <= 3 AND d.y1 - d.y0 >= 10 AND d.x0 > f.edge")
def stray_rules(v):
    """Vertical rules to the right of their page's frame."""
    frame = v.dw.where(F.expr(KIND) == "frame").groupBy("doc_id", "page").agg(F.max("x1").alias("edge"))
    return v.dw.where("x1 - x0 <= 3 AND y1 - y0 >= 10").join(frame, ["doc_id", "page"]).where("x0 > edge").select("doc_id", "page", "did")


@operator("F8 G3 J36", """SELECT DISTINCT a.page_key, a.rid FROM rc a JOIN rc b ON a.page_key = b.page_key AND a.rid <> b.rid WHERE greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.6 * ((a.x1 - a.x0) * (a.y1 - a.y0))
  OR (a.x0 >= b.x0 - 2 AND a.y0 >= b.y0 - 2 AND a.x1 <= b.x1 + 2 AND a.y1 <= b.y1 + 2)""")
def inside_any(v):
    """Rectangles that lie in another of their page: by 60 % of their area, or wholly with 2 points to spare."""
    a, b = v.rc.select("page_key", "rid", "x0", "y0", "x1", "y1"), v.rc.select(F.col("page_key").alias("pk"), *[F.col(c).alias(f"b{c}") for c in ("rid", "x0", "y0", "x1", "y1")])
    shared = F.greatest(F.least("x1", "bx1") - F.greatest("x0", "bx0"), F.lit(0)) * F.greatest(F.least("y1", "by1") - F.greatest("y0", "by0"), F.lit(0))
    held = (F.col("x0") >= F.col("bx0") - 2) & (F.col("y0") >= F.col("by0") - 2) & (F.col("x1") <= F.col("bx1") + 2) & (F.col("y1") <= F.col("by1") + 2)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return a.join(b, (a.page_key == b.pk) & (F.col("rid") != F.col("brid")) & ((shared >= 0.6 * area) | held), "left_semi").select("page_key", "rid")


@operator("F9 F15 A20", """SELECT page, bool_and(regexp_full_match(text, '\\(?[0-9]{1,2}\\)?|[A-K]')) AS bubbles, bool_and(regexp_full_match(text, '[0-9.,/ -]+') OR regexp_full_match(text, '[A-Z]+[-#][0-9]+')) AS codes, count(*) AS n FROM un GROUP BY page""")
def code_columns(v):
    """Whether all units of a page are balloon marks, or numbers and codes."""
    t = F.col("text")
    return v.un.groupBy("page").agg(F.bool_and(t.rlike(r"^(?:\(?[0-9]{1,2}\)?|[A-K])$")).alias("bubbles"), F.bool_and(t.rlike("^[0-9.,/ -]+$") | t.rlike("^[A-Z]+[-#][0-9]+$")).alias("codes"), F.count(F.lit(1)).alias("n"))




@operator("F14 A11 O4", """SELECT description, count(*) AS n, count(DISTINCT page_key) AS pages, min(page_key) AS first_page FROM (SELECT page_key, header, cells[list_position(header, 'PART NAME')] AS description FROM (SELECT page_key, CASE page_key % 3 WHEN 0 THEN ['ITEM', 'PART NAME', 'QTY'] WHEN 1 THEN ['PART NAME', 'QTY'] ELSE ['ITEM', 'NAME', 'QTY'] END AS header, CASE page_key % 3 WHEN 1 THEN [txt, '1'] ELSE [CAST(rid AS VARCHAR), CASE WHEN l_linenumber % 4 = 0 THEN upper(replace(p_brand, '#', '-')) ELSE txt END, '1'] END AS cells FROM rc)
  WHERE list_contains(header, 'PART NAME') AND len(header) >= 3) WHERE NOT regexp_full_match(description, '[A-Z0-9-]+') GROUP BY description""")
def part_descriptions(v):
    """Distinct descriptions of part tables with their frequency and pages.

    Only tables of three columns or more whose header names parts are read, at that column; number-shaped descriptions are dropped.
    """
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    k = F.col("page_key") % 3
    header = F.when(k == 0, words("ITEM", "PART NAME", "QTY")).when(k == 1, words("PART NAME", "QTY")).otherwise(words("ITEM", "NAME", "QTY"))
    name = F.when(F.col("l_linenumber") % 4 == 0, F.upper(F.replace("p_brand", F.lit("#"), F.lit("-")))).otherwise(F.col("txt"))
    cells = F.when(k == 1, F.array("txt", F.lit("1"))).otherwise(F.array(F.col("rid").cast("string"), name, F.lit("1")))
    rows = v.rc.select("page_key", header.alias("header"), cells.alias("cells")).where("array_contains(header, 'PART NAME') AND size(header) >= 3")
    d = rows.select("page_key", F.expr("element_at(cells, CAST(array_position(header, 'PART NAME') AS INT))").alias("description")).where(~F.col("description").rlike("^[A-Z0-9-]+$"))
    return d.groupBy("description").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_key").alias("pages"), F.min("page_key").alias("first_page"))



@operator("F18", """SELECT s.doc_id, s.line_no, d.did FROM st s JOIN dw d ON d.doc_id = s.doc_id AND d.page = s.page AND d.y1 - d.y0 < 0.6 AND (d.y0 + d.y1) / 2 - s.y1 BETWEEN -0.5 AND 3 AND d.x0 >= s.x0 - 2 AND d.x1 <= s.x1 + 2 AND d.x1 - d.x0 >= 0.5 * (s.x1 - s.x0) WHERE trim(s.text) <> ''""")
def underlined_lines(v):
    """Lines with a rule right below (3 points) that lies within them (2 points to spare) and is half as long or longer."""
    d = v.dw.where("y1 - y0 < 0.6").select(F.col("doc_id").alias("dd"), F.col("page").alias("dp"), "did", F.expr("(y0 + y1) / 2").alias("dy_"), F.col("x0").alias("dx0"), F.col("x1").alias("dx1"))
    s = v.st.where("trim(text) <> ''")
    on = F.expr("doc_id = dd AND page = dp AND dy_ - y1 BETWEEN -0.5 AND 3 AND dx0 >= x0 - 2 AND dx1 <= x1 + 2 AND dx1 - dx0 >= 0.5 * (x1 - x0)")
    return s.join(d, on).select("doc_id", "line_no", "did")


@operator("J31", """SELECT r.page_key, r.rid, min(u.x0 - r.x0) AS offset_x FROM rc r JOIN rc u ON r.page_key = u.page_key AND u.rid <> r.rid AND u.size % 2 = 0 AND u.y0 BETWEEN r.y0 AND r.y1 + 8 AND u.x0 BETWEEN r.x0 - 1 AND r.x0 + 26 AND u.x1 - u.x0 >= 0.5 * (r.x1 - r.x0) GROUP BY r.page_key, r.rid""")
def underlined_labels(v):
    """Labels with a rule right below, long enough and starting near them; the nearest start."""
    u = v.rc.where("size % 2 = 0").select(F.col("page_key").alias("pk"), *[F.col(c).alias(f"u{c}") for c in ("rid", "x0", "y0", "x1")])
    r = v.rc
    on = (r.page_key == u.pk) & (F.col("urid") != F.col("rid")) & F.col("uy0").between(F.col("y0"), F.col("y1") + 8) & F.col("ux0").between(F.col("x0") - 1, F.col("x0") + 26) & (F.col("ux1") - F.col("ux0") >= 0.5 * (F.col("x1") - F.col("x0")))
    return r.join(u, on).groupBy("page_key", "rid").agg(F.min(F.col("ux0") - F.col("x0")).alias("offset_x"))



@operator("F20 Q31", """SELECT page_id, ord, title FROM toc WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('Home', 'o'), ('Abo', 'ut'), ('', 'zzz')) w(p, f) WHERE starts_with(title, p) AND contains(title, f))""", big="ord")
def waived_entries(v):
    """Violations that no waiver (prefix, fragment) covers."""
    w = v.spark.createDataFrame([("Home", "o"), ("Abo", "ut"), ("", "zzz")], "p string, f string")
    t = v.toc
    return t.join(F.broadcast(w), t.title.startswith(w.p) & t.title.contains(w.f), "left_anti").select("page_id", "ord", "title")


@operator("F21", "SELECT doc_id, line_no FROM ln WHERE regexp_matches(text, '^[a-z]') OR regexp_matches(text, '\\b(of|the|and|to|de|la|der|die)$')")
def orphan_fragments(v):
    """Lines that start in lower case or end in a function word."""
    return v.ln.where(F.col("text").rlike("^[a-z]") | F.col("text").rlike(r"\b(of|the|and|to|de|la|der|die)$")).select("doc_id", "line_no")



@operator("F24 O7", """SELECT s_suppkey, cc, list(tag ORDER BY coalesce(tag = pin, false) DESC, tag DESC)[1:3] AS tags FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 121 END AS pin, 50 + s_nationkey * 3 AS cc, 120 + s_suppkey % 15 AS cuda FROM supplier), (VALUES (118), (121), (124), (126), (128), (130), (134)) t(tag)
  WHERE tag <= cuda + 6 AND (cc < 100 OR tag >= 124) AND (cc >= 70 OR tag < 130) GROUP BY s_suppkey, cc""", big="cc")
def wheel_selection(v):
    """Up to three build tags that a device's capability and driver allow: a pinned one first, then the newest."""
    s = v.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, 121).alias("pin"), (50 + F.col("s_nationkey") * 3).alias("cc"), (120 + F.col("s_suppkey") % 15).alias("cuda"))
    t = v.spark.createDataFrame([(x,) for x in (118, 121, 124, 126, 128, 130, 134)], "tag int")
    j = s.join(F.broadcast(t), (t.tag <= s.cuda + 6) & ((s.cc < 100) | (t.tag >= 124)) & ((s.cc >= 70) | (t.tag < 130)))
    return j.groupBy("s_suppkey", "cc").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col("tag") == F.col("pin"), F.lit(False)).alias("first"), "tag")), False), 1, 3), lambda x: x["tag"]).alias("tags"))
