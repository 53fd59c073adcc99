"""Further operators on extracted pages: tables and prose, rules and bands, page texts, widths, groups and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.operators.pages import PAGE
from foliomill.operators.regions import BOX, boxes, rule_families
from foliomill.plans.registry import RAW, operator


@operator("S3 J5", """WITH tb AS (FAMILIES) SELECT l.page_key, l.rid FROM bx l WHERE l.size <= 7 AND NOT EXISTS (SELECT 1 FROM tb t WHERE t.page_key = l.page_key AND greatest(least(l.x1, t.b + 2) - greatest(l.x0, t.a - 2), 0) * greatest(least(l.y1, t.bottom + 2) - greatest(l.y0, t.top - 2), 0) > 0.5 * ((l.x1 - l.x0) * (l.y1 - l.y0)))""".replace("FAMILIES", RAW["rule_families"]))
def prose_outside_tables(v):
    """Lines that lie by half or less in any table; tables are the families of rules found on the page, two points wider."""
    t = rule_families(v).select(F.col("page_key").alias("tp"), "a", "b", "top", "bottom")
    line = boxes(v).where("size <= 7").select("page_key", "rid", *BOX)
    inside = F.expr("page_key = tp AND greatest(least(x1, b + 2) - greatest(x0, a - 2), 0) * greatest(least(y1, bottom + 2) - greatest(y0, top - 2), 0) > 0.5 * ((x1 - x0) * (y1 - y0))")
    return line.join(t, inside, "left_anti").select("page_key", "rid")


EDGE = "SELECT doc_id, page, 'H' AS axis, y0 AS k, x0 AS a, x1 AS b FROM solid UNION ALL SELECT doc_id, page, 'H', y1, x0, x1 FROM solid UNION ALL SELECT doc_id, page, 'V', x0, y0, y1 FROM solid UNION ALL SELECT doc_id, page, 'V', x1, y0, y1 FROM solid"


@operator("S6 G5 D6 D7", f"""WITH solid AS (SELECT * FROM dw WHERE x1 - x0 >= 0.6 AND y1 - y0 >= 0.6) SELECT DISTINCT doc_id, page, axis, k, a, b FROM (SELECT doc_id, page, 'H' AS axis, (y0 + y1) / 2 AS k, x0 AS a, x1 AS b FROM dw WHERE y1 - y0 < 0.6 UNION ALL SELECT doc_id, page, 'V', (x0 + x1) / 2, y0, y1 FROM dw WHERE x1 - x0 < 0.6 AND y1 - y0 >= 0.6 UNION ALL {EDGE}) WHERE b - a >= 9""")
def segments_distinct(v):
    """Drawings as horizontal and vertical segments of at least 9 points: lines and rectangles thinner than 0.6 are one, others four."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    seg = lambda axis, k, a, b: F.struct(F.lit(axis).alias("axis"), k.alias("k"), F.col(a).alias("a"), F.col(b).alias("b"))
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    four = F.array(seg("H", F.col("y0"), "x0", "x1"), seg("H", F.col("y1"), "x0", "x1"), seg("V", F.col("x0"), "y0", "y1"), seg("V", F.col("x1"), "y0", "y1"))
    each = F.when(h < 0.6, F.array(seg("H", mid("y0", "y1"), "x0", "x1"))).when(w < 0.6, F.array(seg("V", mid("x0", "x1"), "y0", "y1"))).otherwise(four)
    return v.dw.select(*PAGE, F.explode(each).alias("s")).select(*PAGE, "s.*").where("b - a >= 9").distinct()


@operator("S23", """SELECT t.doc_id, t.top, t.bottom, coalesce(r.wide, 0) AS wide_rules, coalesce(r.pages, 0) AS rule_pages, coalesce(r.halves, 0) AS half_tables, coalesce(i.n, 0) AS images FROM (SELECT doc_id, min(y0) AS top, max(y1) AS bottom FROM st WHERE trim(text) <> '' GROUP BY doc_id) t LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE y1 - y0 < 0.6 AND x1 - x0 >= 120) AS wide, count(DISTINCT CASE WHEN y1 - y0 < 0.6 AND x1 - x0 >= 120 THEN page END) AS pages, count(*) FILTER (WHERE y1 - y0 >= 10 AND x1 - x0 BETWEEN 200 AND 330) AS halves FROM dw GROUP BY doc_id) r ON r.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM pl GROUP BY doc_id) i ON i.doc_id = t.doc_id""")
def geometry_survey(v):
    """The geometry of a document: highest and lowest text, wide rules and the pages that have some, half-width boxes, images."""
    wide = (F.col("y1") - F.col("y0") < 0.6) & (F.col("x1") - F.col("x0") >= 120)
    half = (F.col("y1") - F.col("y0") >= 10) & (F.col("x1") - F.col("x0")).between(200, 330)
    t = v.st.where("trim(text) <> ''").groupBy("doc_id").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    r = v.dw.groupBy("doc_id").agg(F.count_if(wide).alias("wide_rules"), F.countDistinct(F.when(wide, F.col("page"))).alias("rule_pages"), F.count_if(half).alias("half_tables"))
    i = v.pl.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images"))
    return t.join(r, "doc_id", "left").join(i, "doc_id", "left").fillna(0, ["wide_rules", "rule_pages", "half_tables", "images"])


@operator("P16 D17", """SELECT category, line, max(CASE WHEN k = 0 THEN term END) AS left_term, max(CASE WHEN k = 1 THEN term END) AS right_term, line = 0 AS header FROM (SELECT p_brand AS category, CAST(0 AS BIGINT) AS line, 0 AS k, p_brand AS term FROM part UNION ALL SELECT p_brand, (rn - 1) // 2 + 1, (rn - 1) % 2, term FROM (SELECT p_brand, p_name AS term, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS rn FROM (SELECT DISTINCT p_brand, p_name FROM part))) GROUP BY category, line""")
def glossary_pairs(v):
    """Each category's header row, then its terms, two to a line in row-major order."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name")) - 1
    t = v.part.select("p_brand", "p_name").distinct().withColumn("rn", n).select(F.col("p_brand").alias("category"), (F.floor(F.col("rn") / 2) + 1).alias("line"), (F.col("rn") % 2).alias("k"), F.col("p_name").alias("term"))
    head = v.part.select(F.col("p_brand").alias("category"), F.lit(0).cast("long").alias("line"), F.lit(0).alias("k"), F.col("p_brand").alias("term"))
    side = lambda k: F.max(F.when(F.col("k") == k, F.col("term")))
    return t.unionByName(head).groupBy("category", "line").agg(side(0).alias("left_term"), side(1).alias("right_term")).withColumn("header", F.col("line") == 0)


@operator("P19", """SELECT p.doc_id, p.page, coalesce(arg_max(s.tag || '-' || (p.page - s.p0 + 1), s.p0), CAST(p.page AS VARCHAR)) AS printed FROM pg p LEFT JOIN (SELECT doc_id, page AS p0, arg_min(split_part(text, ' ', 1), line_no) AS tag FROM st WHERE k = 7 GROUP BY ALL) s ON s.doc_id = p.doc_id AND s.p0 <= p.page GROUP BY p.doc_id, p.page""")
def printed_page_text(v):
    """What is printed for each physical page: the last part that begins at or before it and the place in that part, else the number."""
    s = v.st.where("k = 7").groupBy("doc_id", "page").agg(F.min_by(F.split_part("text", F.lit(" "), F.lit(1)), "line_no").alias("tag"))
    p = v.pg.select(*PAGE).join(s, PAGE, "left")
    w = Window.partitionBy("doc_id").orderBy("page")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    at = F.when(F.col("tag").isNotNull(), F.col("page"))
    p = p.select(*PAGE, last("tag").alias("tag"), last(at).alias("p0"))
    return p.select(*PAGE, F.coalesce(F.when(F.col("tag").isNotNull(), F.concat("tag", F.lit("-"), (F.col("page") - F.col("p0") + 1).cast("string"))), F.col("page").cast("string")).alias("printed"))


# ---------------------------------------------------------------- rules and bands

BAND = "SELECT page_key, k AS top, lead(k) OVER (PARTITION BY page_key ORDER BY k) AS bottom FROM (SELECT DISTINCT page_key, k FROM sg WHERE axis = 'H')"


def bands(v):
    h = v.sg.where("axis = 'H'").select("page_key", F.col("k").alias("top")).distinct()
    return h.withColumn("bottom", F.lead("top").over(Window.partitionBy("page_key").orderBy("top"))).where("bottom IS NOT NULL")


@operator("J10", f"SELECT h.page_key, h.top, h.bottom, count(DISTINCT s.k) AS verticals FROM ({BAND}) h JOIN sg s ON s.page_key = h.page_key AND s.axis = 'V' AND s.a <= h.top + 1.5 AND s.b >= h.bottom - 1.5 WHERE h.bottom IS NOT NULL GROUP BY ALL", big="top bottom")
def band_verticals(v):
    """Vertical rules that span a whole row band, from its upper to its lower rule, give or take 1.5 points."""
    s = v.sg.where("axis = 'V'").select(F.col("page_key").alias("sp"), "k", "a", "b")
    return bands(v).join(s, F.expr("page_key = sp AND a <= top + 1.5 AND b >= bottom - 1.5")).groupBy("page_key", "top", "bottom").agg(F.countDistinct("k").alias("verticals"))


@operator("J12", """SELECT page_key, r, count(*) AS merged FROM (SELECT g.page_key, h.k AS r, g.x0, g.x1 FROM (SELECT page_key, k AS x0, lead(k) OVER (PARTITION BY page_key ORDER BY k) AS x1 FROM (SELECT DISTINCT page_key, k FROM sg WHERE axis = 'V')) g JOIN (SELECT DISTINCT page_key, k FROM sg WHERE axis = 'H') h ON h.page_key = g.page_key WHERE g.x1 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sg s WHERE s.page_key = g.page_key AND s.axis = 'H' AND s.k = h.k AND s.a <= (g.x0 + g.x1) / 2 AND s.b >= (g.x0 + g.x1) / 2)) GROUP BY page_key, r""", big="r")
def missing_rules(v):
    """Cells of a page's own grid under whose middle no rule runs, by row: each merges with the cell below."""
    x = v.sg.where("axis = 'V'").select("page_key", F.col("k").alias("x0")).distinct()
    x = x.withColumn("x1", F.lead("x0").over(Window.partitionBy("page_key").orderBy("x0"))).where("x1 IS NOT NULL")
    rows = v.sg.where("axis = 'H'").select("page_key", F.col("k").alias("r")).distinct()
    h = v.sg.where("axis = 'H'").select(F.col("page_key").alias("hp"), F.col("k").alias("hk"), "a", "b")
    lacking = x.join(rows, "page_key").join(h, F.expr("page_key = hp AND r = hk AND a <= (x0 + x1) / 2 AND b >= (x0 + x1) / 2"), "left_anti")
    return lacking.groupBy("page_key", "r").agg(F.count(F.lit(1)).alias("merged"))


@operator("C8 D9", f"""SELECT b.page_key, b.top, b.bottom, len(c.cols) AS own, len(list_distinct(list_concat(c.cols, list_filter(m.main, lambda x: x > list_min(c.cols) AND x < list_max(c.cols))))) AS filled FROM ({BAND}) b JOIN (SELECT page_key, top, list(DISTINCT k) AS cols FROM (SELECT h.page_key, h.top, s.k FROM ({BAND}) h JOIN sg s ON s.page_key = h.page_key AND s.axis = 'V' AND s.a <= h.top + 1.5 AND s.b >= h.bottom - 1.5) GROUP BY ALL) c ON c.page_key = b.page_key AND c.top = b.top
  JOIN (SELECT page_key, list(k) FILTER (WHERE n >= 0.6 * bands) AS main FROM (SELECT page_key, k, count(DISTINCT top) AS n FROM (SELECT h.page_key, h.top, s.k FROM ({BAND}) h JOIN sg s ON s.page_key = h.page_key AND s.axis = 'V' AND s.a <= h.top + 1.5 AND s.b >= h.bottom - 1.5) GROUP BY ALL) JOIN (SELECT page_key, count(DISTINCT top) AS bands FROM (SELECT h.page_key, h.top FROM ({BAND}) h JOIN sg s ON s.page_key = h.page_key AND s.axis = 'V' AND s.a <= h.top + 1.5 AND s.b >= h.bottom - 1.5) GROUP BY page_key) USING (page_key) GROUP BY page_key) m ON m.page_key = b.page_key""", big="top bottom")
def row_bands(v):
    """Bands of a table with their columns, and how many they have once main columns (in 60 % of the bands) within their extent are filled in."""
    s = v.sg.where("axis = 'V'").select(F.col("page_key").alias("sp"), "k", "a", "b")
    hit = bands(v).join(s, F.expr("page_key = sp AND a <= top + 1.5 AND b >= bottom - 1.5")).select("page_key", "top", "bottom", "k").distinct()
    n = hit.groupBy("page_key").agg(F.countDistinct("top").alias("bands"))
    main = hit.groupBy("page_key", "k").agg(F.countDistinct("top").alias("n")).join(n, "page_key").groupBy("page_key").agg(F.collect_list(F.when(F.col("n") >= 0.6 * F.col("bands"), F.col("k"))).alias("main"))
    cols = hit.groupBy("page_key", "top", "bottom").agg(F.collect_list("k").alias("cols")).join(main, "page_key")
    add = F.filter("main", lambda x: (x > F.array_min("cols")) & (x < F.array_max("cols")))
    return cols.select("page_key", "top", "bottom", F.size("cols").alias("own"), F.size(F.array_union("cols", add)).alias("filled"))


@operator("G9", """SELECT page_key, rid, list_reduce(list_concat([y0], flatten([ts, ts, ts, ts, ts, ts, ts, ts, ts, ts])), lambda top, y: CASE WHEN y > top AND y - top < 20 THEN y ELSE top END) AS top FROM (SELECT f.page_key, f.rid, f.y0, list(t.y1 ORDER BY t.rid) AS ts FROM bx f JOIN bx t ON t.page_key = f.page_key AND t.size = 7 AND t.x0 < f.x1 AND t.x1 > f.x0 AND t.y1 > f.y0 AND t.y0 < f.y1 + 60 WHERE f.size = 10 GROUP BY ALL)""")
def trimmed_top(v):
    """A cluster's upper edge pushed below each blocking line that overlaps it sideways and lies within 20 points, in ten passes."""
    r = boxes(v)
    f = r.where("size = 10").select("page_key", "rid", *BOX)
    t = r.where("size = 7").select(F.col("page_key").alias("tp"), F.col("rid").alias("trid"), *[F.col(c).alias(f"t{c}") for c in BOX])
    g = f.join(t, F.expr("page_key = tp AND tx0 < x1 AND tx1 > x0 AND ty1 > y0 AND ty0 < y1 + 60")).groupBy("page_key", "rid", "y0").agg(F.array_sort(F.collect_list(F.struct("trid", "ty1"))).alias("ts"))
    step = lambda top, x: F.when((x["ty1"] > top) & (x["ty1"] - top < 20), x["ty1"]).otherwise(top)
    return g.select("page_key", "rid", F.aggregate(F.flatten(F.array_repeat("ts", 10)), F.col("y0"), step).alias("top"))


OPEN = "u[1].y - g.y <= 1.5 * u[1].s AND u[1].y >= g.y - 40 AND abs(u[1].s - g.s) <= 1 AND (least(u[1].b, g.b) > greatest(u[1].x, g.x) OR abs(u[1].x - g.x) <= 24)"


@operator("X5", f"""SELECT page_key, CAST(len(f) AS BIGINT) AS groups, list_max(list_transform(f, lambda g: g.n)) AS largest, list_sum(list_transform(f, lambda g: g.b - g.x)) AS widths FROM (SELECT page_key, list_reduce(us, lambda acc, u: CASE WHEN len(list_filter(acc, lambda g: {OPEN})) = 0 THEN list_append(acc, u[1]) ELSE list_transform(acc, lambda g, j: CASE WHEN j = len(acc) - list_position(list_reverse(list_transform(acc, lambda g: {OPEN})), true) + 1 THEN {{'x': least(g.x, u[1].x), 'b': greatest(g.b, u[1].b), 'y': greatest(g.y, u[1].y), 's': g.s, 'n': g.n + 1}} ELSE g END) END) AS f
  FROM (SELECT page_key, list([{{'x': x0, 'b': x1, 'y': y0, 's': CAST(size AS DOUBLE), 'n': CAST(1 AS BIGINT)}}] ORDER BY y0, rid) AS us FROM bx GROUP BY page_key))""")
def slide_groups(v):
    """Units attached to the latest group that is open to them: near in height, alike in size, overlapping sideways or little indented.

    The group's box grows with each.
    """
    u = boxes(v).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("y0", "rid", "x0", "x1", F.col("size").cast("double").alias("s")))).alias("us"))
    empty = F.array().cast("array<struct<x:double,b:double,y:double,s:double,n:bigint>>")

    def step(acc, e):
        near = lambda g: (e["y0"] - g["y"] <= 1.5 * e["s"]) & (e["y0"] >= g["y"] - 40) & (F.abs(e["s"] - g["s"]) <= 1) & ((F.least(e["x1"], g["b"]) > F.greatest(e["x0"], g["x"])) | (F.abs(e["x0"] - g["x"]) <= 24))
        at = F.size(acc) - F.array_position(F.reverse(F.transform(acc, near)), F.lit(True)) + 1
        one = F.struct(e["x0"].alias("x"), e["x1"].alias("b"), e["y0"].alias("y"), e["s"].alias("s"), F.lit(1).cast("long").alias("n"))
        grown = lambda g: F.struct(F.least(g["x"], e["x0"]).alias("x"), F.greatest(g["b"], e["x1"]).alias("b"), F.greatest(g["y"], e["y0"]).alias("y"), g["s"].alias("s"), (g["n"] + 1).alias("n"))
        return F.when(~F.exists(acc, near), F.array_append(acc, one)).otherwise(F.transform(acc, lambda g, j: F.when(j + 1 == at, grown(g)).otherwise(g)))

    f = u.select("page_key", F.aggregate("us", empty, step).alias("f"))
    total = F.aggregate(F.transform("f", lambda g: g["b"] - g["x"]), F.lit(0.0), lambda a, x: a + x)
    return f.select("page_key", F.size("f").alias("groups"), F.array_max(F.transform("f", lambda g: g["n"])).alias("largest"), total.alias("widths"))


@operator("X12", """SELECT page_key, rid, CASE WHEN abs((x0 + x1) / 2 - 306) <= greatest(6, 0.05 * (x1 - x0)) THEN 'centred' ELSE 'right' END AS align FROM (SELECT b.*, (SELECT count(*) FROM bx o WHERE o.page_key = b.page_key AND o.rid <> b.rid AND abs(o.x1 - b.x1) <= 2) AS same_right FROM bx b) WHERE abs((x0 + x1) / 2 - 306) <= greatest(6, 0.05 * (x1 - x0)) OR (same_right >= 2 AND x0 > 306)""")
def aligned_units(v):
    """Units centred on the page, and units of its right half that share their right edge (2 points) with two others."""
    r = boxes(v)
    o = r.select(F.col("page_key").alias("op"), F.col("rid").alias("orid"), F.col("x1").alias("ox1"))
    n = r.join(o, F.expr("page_key = op AND orid <> rid AND abs(ox1 - x1) <= 2"), "left").groupBy("page_key", "rid", "x0", "x1").agg(F.count("orid").alias("same"))
    centred = F.expr("abs((x0 + x1) / 2 - 306) <= greatest(6, 0.05 * (x1 - x0))")
    return n.where(centred | F.expr("same >= 2 AND x0 > 306")).select("page_key", "rid", F.when(centred, "centred").otherwise("right").alias("align"))


@operator("J37 Q29", """SELECT s.doc_id, s.page, s.block, o.x0 - s.x0 AS moved, o.n - s.n AS lines FROM (SELECT doc_id, page, line_no // 5 AS block, min(x0) AS x0, count(*) AS n FROM st WHERE trim(text) <> '' GROUP BY ALL) s JOIN (SELECT doc_id - 1 AS doc_id, page, line_no // 5 AS block, min(x0) AS x0, count(*) AS n FROM st WHERE trim(text) <> '' GROUP BY ALL) o ON o.doc_id = s.doc_id AND o.page = s.page AND o.block = s.block WHERE abs(o.x0 - s.x0) > 2 OR o.n <> s.n""")
def band_alignment(v):
    """Blocks of paired pages, band by band, whose left edge moved by over 2 points or that gained or lost lines."""
    b = v.st.where("trim(text) <> ''").groupBy(*PAGE, F.floor(F.col("line_no") / 5).alias("block")).agg(F.min("x0").alias("x0"), F.count(F.lit(1)).alias("n"))
    o = b.select((F.col("doc_id") - 1).alias("doc_id"), "page", "block", F.col("x0").alias("ox"), F.col("n").alias("on_"))
    j = b.join(o, [*PAGE, "block"]).select(*PAGE, "block", (F.col("ox") - F.col("x0")).alias("moved"), (F.col("on_") - F.col("n")).alias("lines"))
    return j.where("abs(moved) > 2 OR lines <> 0")


# ---------------------------------------------------------------- texts, widths, requests, evidence


@operator("T4 T25", r"""SELECT page_key, rid, regexp_replace(regexp_replace(s, '\b([A-Z]{1,2}[a-z]?)([0-9])([A-Z]?)\b', '\1<sub>\2</sub>\3', 'g'), '10\^([0-9]+)', '10<sup>\1</sup>', 'g') AS tagged, regexp_replace(regexp_replace('a <sub>' || rid || '</sub> b<sup>' || size || '</sup>', '<sub>([^<]*)</sub>', '<span rise="-2">\1</span>', 'g'), '<sup>([^<]*)</sup>', '<span rise="3">\1</span>', 'g') AS risen FROM (SELECT page_key, rid, size, 'H2S and CO2 at 10^' || size || ' near A' || (rid % 10) || ' of X12' AS s FROM rc)""")
def raised_texts(v):
    """Digits of formulas tagged as subscripts and powers of ten as superscripts; tags rewritten as raised or lowered spans."""
    size, rid = F.col("size").cast("string"), F.col("rid").cast("string")
    s = F.concat(F.lit("H2S and CO2 at 10^"), size, F.lit(" near A"), (F.col("rid") % 10).cast("string"), F.lit(" of X12"))
    tagged = F.regexp_replace(F.regexp_replace(s, r"\b([A-Z]{1,2}[a-z]?)([0-9])([A-Z]?)\b", "$1<sub>$2</sub>$3"), r"10\^([0-9]+)", "10<sup>$1</sup>")
    tags = F.concat(F.lit("a <sub>"), rid, F.lit("</sub> b<sup>"), size, F.lit("</sup>"))
    risen = F.regexp_replace(F.regexp_replace(tags, "<sub>([^<]*)</sub>", '<span rise="-2">$1</span>'), "<sup>([^<]*)</sup>", '<span rise="3">$1</span>')
    return v.rc.select("page_key", "rid", tagged.alias("tagged"), risen.alias("risen"))


# Fixed patterns of tokens that are never broken, longest first: units in brackets, sizes in fractions, numbers, dates, part numbers, ranges,
# inches, measures, standards, single joints, thousands, names.
ATOMS = (
    r"[（(][A-Za-z0-9/·.%°µ]{1,10}[）)]",
    r"\d+-\d+/\d+\s?[A-Z]{0,4}",
    r"\d{5,}",
    r"\d{4}-\d{1,2}-\d{1,2}",
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"(?:[A-Z0-9]+[-.]){2,}[A-Z0-9]+",
    r"\d+(?:\.\d+)?[\"″'′]?\s*[~～–—-]\s*\d+(?:\.\d+)?[\"″'′]?(?![-.]\d)",
    r"\d+(?:\.\d+)?[\"″'′]",
    r"\d+(?:,\d{3})*(?:\.\d+)?\s?(?:psi|ksi|kgf|lbf|klbs|rpm|mm|cm|µm|um|in|ft|°F|°C|HV|N·m|Nm|gal|ppg|kg|lb)\b",
    r"[A-Z]{2,}\s?[A-Z]?\d{2,}(?:[.\-/]\d+)*",
    r"[A-Z0-9]+[-.][A-Z0-9]+",
    r"\d+(?:,\d{3})+(?:\.\d+)?",
    r"[A-Z][A-Za-z]{5,}",
)
ATOM = "(?i)(" + "|".join(ATOMS) + ")"


@operator("T3")
def atom_tokens(v):
    """Tokens of each line that are never broken, in order."""
    return v.st.select("doc_id", "line_no", F.regexp_extract_all("text", F.lit(ATOM), 1).alias("atoms")).where("size(atoms) > 0")


WIDTHS = "CASE WHEN tn <= 540 THEN natural_w + (540 - tn) * natural_w / tn WHEN tf <= 540 THEN floor_w + (540 - tf) * CASE WHEN tn > tf THEN (natural_w - floor_w) / (tn - tf) ELSE 0 END ELSE 540 * floor_w / tf END"


@operator("A21 N6", f"""SELECT page_key, col, floor_w, natural_w, {WIDTHS} AS width FROM (SELECT *, sum(floor_w) OVER (PARTITION BY page_key) AS tf, sum(natural_w) OVER (PARTITION BY page_key) AS tn FROM (SELECT page_key, col, CAST(max(word) AS DOUBLE) AS floor_w, CAST(max(whole) AS DOUBLE) AS natural_w FROM (SELECT page_key, CAST(floor(x0 / 90) AS BIGINT) AS col, 6 * length(txt) AS whole, 6 * list_max(list_transform(string_split(txt, ' '), lambda w: length(w))) AS word FROM bx) GROUP BY ALL))""")
def column_widths(v):
    """Widths of a page's columns in 540 points: natural ones stretched, else what exceeds the widest atoms shrunk, else atoms in proportion."""
    word = F.array_max(F.transform(F.split("txt", " "), lambda w: F.length(w)))
    c = boxes(v).groupBy("page_key", F.floor(F.col("x0") / 90).alias("col")).agg(F.max(6 * word).cast("double").alias("floor_w"), F.max(6 * F.length("txt")).cast("double").alias("natural_w"))
    w = Window.partitionBy("page_key")
    c = c.withColumn("tf", F.sum("floor_w").over(w)).withColumn("tn", F.sum("natural_w").over(w))
    return c.select("page_key", "col", "floor_w", "natural_w", F.expr(WIDTHS).alias("width"))


@operator("L2", """SELECT page_key, rid, coalesce(list_filter(list_transform(range(0, 51), lambda i: 16 - 0.2::DOUBLE * i), lambda s: length(txt) * 0.55::DOUBLE * s <= 1.2::DOUBLE * (x1 - x0))[1], 6.0) AS size FROM bx WHERE size = 10""")
def masthead_size(v):
    """The largest size from 16 down to 6, in steps of 0.2, at which a title fits its box."""
    sizes = F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: 16 - 0.2 * i.cast("double"))
    fit = F.filter(sizes, lambda s: F.length("txt") * 0.55 * s <= 1.2 * (F.col("x1") - F.col("x0")))
    return boxes(v).where("size = 10").select("page_key", "rid", F.coalesce(F.get(fit, F.lit(0)), F.lit(6.0)).alias("size"))


@operator("L9", """SELECT a.page_key, a.rid, need, least(need, coalesce(min(b.y0), 792.0) - a.y1) AS borrowed, need > coalesce(min(b.y0), 792.0) - a.y1 AS short FROM (SELECT *, greatest(0, ceil(length(txt) * 0.55 * size / (x1 - x0)) * 1.2 * size - (y1 - y0)) AS need FROM bx) a LEFT JOIN bx b ON b.page_key = a.page_key AND b.rid <> a.rid AND b.y0 >= a.y1 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 WHERE need > 0 GROUP BY a.page_key, a.rid, need, a.y1""")
def borrowed_room(v):
    """Boxes too low for their text borrow from the room below, down to the next box; they are short if that isn't enough."""
    r = boxes(v)
    a = r.withColumn("need", F.expr("greatest(0, ceil(length(txt) * 0.55D * size / (x1 - x0)) * 1.2D * size - (y1 - y0))")).where("need > 0").select("page_key", "rid", *BOX, "need")
    b = r.select(F.col("page_key").alias("bp"), F.col("rid").alias("brid"), *[F.col(c).alias(f"b{c}") for c in BOX])
    g = a.join(b, F.expr("page_key = bp AND brid <> rid AND by0 >= y1 AND least(x1, bx1) - greatest(x0, bx0) > 0"), "left").groupBy("page_key", "rid", "need", "y1").agg(F.min("by0").alias("next"))
    room = F.coalesce("next", F.lit(792.0)) - F.col("y1")
    return g.select("page_key", "rid", "need", F.least("need", room).alias("borrowed"), (F.col("need") > room).alias("short"))


@operator("Z5 N8", """SELECT user_id, request, count(*) AS attempts, least(count(*) - 1, 3) AS retries, max(CASE WHEN value <= 20 THEN 0 ELSE 1 END) = 1 AND count(*) <= 4 AS answered, list_sum(list_transform(range(0, least(count(*) - 1, 3)), lambda k: 1.5 * power(2, k))) AS waited FROM (SELECT user_id, value, coalesce(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS request FROM events) GROUP BY user_id, request""", big="request retries")
def retried_requests(v):
    """Requests as runs of refusals (low values) up to an answer: three retries at most, with waits of 1.5 seconds that double."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.when(F.col("value") > 20, 1).otherwise(0)
    e = v.events.select("user_id", "value", F.coalesce(F.sum(ok).over(before), F.lit(0)).alias("request"))
    g = e.groupBy("user_id", "request").agg(F.count(F.lit(1)).alias("attempts"), F.max(F.when(F.col("value") <= 20, 0).otherwise(1)).alias("got"))
    k = F.least(F.col("attempts") - 1, F.lit(3))
    return g.select("user_id", "request", "attempts", k.alias("retries"), ((F.col("got") == 1) & (F.col("attempts") <= 4)).alias("answered"), F.when(k > 0, 1.5 * (F.pow(F.lit(2.0), k.cast("double")) - 1)).alias("waited"))


# Fixed families of evidence: standards, units, numbering and terms, with their weight.
FAMILIES = (("standard", r"\b(?:API|ISO|ASTM|DIN)\b", 5), ("unit", r"\b(?:psi|mm|rpm|lbf)\b", 3), ("numbering", r"\b[0-9]+\.[0-9]+(?:\.[0-9]+)*\b", 2), ("note", r"\b(?:UNLESS OTHERWISE|FIN|ANG)\b", 4), ("form", r"_{4,}|:$", 1))


@operator("Y16", "SELECT doc_id, CAST(sum(n * w) AS BIGINT) AS strength, arg_max(family, {'s': n * w, 'f': family}) AS family FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS family, {w} AS w, CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS n FROM st GROUP BY doc_id" for f, p, w in FAMILIES) + ") WHERE n > 0 GROUP BY doc_id")
def industry_evidence(v):
    """Evidence of a field in each document: standards, units, numbering, notes and forms, weighted, with the strongest family."""
    counts = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(w).alias("w"), F.regexp_count("text", F.lit(p)).alias("n")) for f, p, w in FAMILIES])
    e = v.st.select("doc_id", F.explode(counts).alias("c")).groupBy("doc_id", "c.family", "c.w").agg(F.sum("c.n").alias("n")).where("n > 0")
    s = F.col("n") * F.col("w")
    return e.groupBy("doc_id").agg(F.sum(s).alias("strength"), F.max_by("family", F.struct(s, "family")).alias("family"))


@operator("O8", "SELECT page_key, rid, row_number() OVER (PARTITION BY page_key ORDER BY y0, x0, rid) AS place FROM bx")
def detection_order(v):
    """Detected boxes in reading order, by top and left edge; equal ones keep their order."""
    return boxes(v).select("page_key", "rid", F.row_number().over(Window.partitionBy("page_key").orderBy("y0", "x0", "rid")).alias("place"))


FIT = "floor(least(10.0, greatest(4.0, (x1 - x0) / (0.55 * length(txt)))) * 4) / 4"


@operator("L12", f"""WITH tb AS (FAMILIES), cells AS (SELECT t.page_key, t.a, t.top, b.rid, b.y0, {FIT.replace('10.0', '10.0::DOUBLE').replace('0.55', '0.55::DOUBLE')} AS fit FROM tb t JOIN bx b ON b.page_key = t.page_key AND b.x0 >= t.a - 2 AND b.x1 <= t.b + 2 AND b.y0 >= t.top AND b.y1 <= t.bottom + 2)
  SELECT c.page_key, c.a, c.top, c.rid, (SELECT count(*) FROM hr WHERE hr.page_key = c.page_key AND hr.y > c.top AND hr.y <= c.y0) AS row, min(fit) OVER (PARTITION BY c.page_key, c.a, c.top) AS size FROM cells c""".replace("FAMILIES", RAW["rule_families"]))
def table_plan(v):
    """What a table's rebuilding writes: each cell with its row, counted by the rules above it, and the one size at which all cells fit."""
    from foliomill.operators.regions import rules

    t = rule_families(v).select(F.col("page_key").alias("tp"), "a", "b", "top", "bottom")
    inside = F.expr("page_key = tp AND x0 >= a - 2 AND x1 <= b + 2 AND y0 >= top AND y1 <= bottom + 2")
    cells = boxes(v).join(t, inside).select("page_key", "a", "top", "rid", "y0", F.expr(FIT.replace("10.0", "10.0D").replace("4.0", "4.0D").replace("0.55", "0.55D")).alias("fit"))
    r = rules(v).select(F.col("page_key").alias("rp"), "y")
    n = cells.join(r, F.expr("page_key = rp AND y > top AND y <= y0"), "left").groupBy("page_key", "a", "top", "rid", "fit").agg(F.count("y").alias("row"))
    return n.select("page_key", "a", "top", "rid", "row", F.min("fit").over(Window.partitionBy("page_key", "a", "top")).alias("size"))


@operator("J38", r"""SELECT s.doc_id, s.page, s.token FROM (SELECT DISTINCT doc_id, page, unnest(regexp_extract_all(text, '[A-Za-z0-9.]*[0-9][A-Za-z0-9.]*')) AS token FROM st) s JOIN (SELECT doc_id - 1 AS doc_id, page, string_agg(regexp_replace(text, '\s', '', 'g'), '' ORDER BY line_no) AS out FROM st GROUP BY ALL) o ON o.doc_id = s.doc_id AND o.page = s.page WHERE NOT contains(o.out, s.token)""")
def page_tokens_missing(v):
    """Tokens with a digit that the page of the same number of the paired document lacks; blanks don't count."""
    t = v.st.select(*PAGE, F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9.]*[0-9][A-Za-z0-9.]*"), 0)).alias("token")).distinct()
    o = v.st.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("text", r"\s", "").alias("t")))).alias("ls"))
    o = o.select((F.col("doc_id") - 1).alias("doc_id"), "page", F.array_join(F.col("ls.t"), "").alias("out"))
    return t.join(o, PAGE).where(~F.col("out").contains(F.col("token"))).select(*PAGE, "token")


@operator("U8 P18", """SELECT p.doc_id, p.page, s.tag || '-' || (p.page - s.p0 + 1) AS label FROM pg p JOIN (SELECT doc_id, tag, p0, coalesce(lead(p0) OVER (PARTITION BY doc_id ORDER BY p0) - 1, n) AS p1 FROM (SELECT s.doc_id, arg_min(split_part(text, ' ', 1), line_no) AS tag, page AS p0, any_value(n) AS n FROM st s JOIN (SELECT doc_id, max(page) AS n FROM st GROUP BY ALL) m ON m.doc_id = s.doc_id WHERE k = 7 GROUP BY s.doc_id, page)) s ON s.doc_id = p.doc_id AND p.page BETWEEN s.p0 AND s.p1""")
def appendix_page_set(v):
    """The pages of each part of a document, from its span, with their labels."""
    from foliomill.operators.pages import appendix_spans

    s = appendix_spans(v).select("doc_id", "tag", "p0", F.explode(F.sequence("p0", "p1")).alias("page"))
    return s.select("doc_id", "page", F.concat("tag", F.lit("-"), (F.col("page") - F.col("p0") + 1).cast("string")).alias("label"))


@operator("Y17", r"""SELECT doc_id, line_no, regexp_replace(text, '(^|[^0-9])\.([0-9])', '\10.\2', 'g') AS zeros, format('{:,}', line_no * 1237 + doc_id) AS grouped, regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})+') AS kept FROM (SELECT doc_id, line_no, replace(text, '.5 psi', ' .5 psi') AS text FROM st WHERE k IN (3, 11))""")
def number_forms(v):
    """Numbers as they are printed: a zero before a bare point, thousands grouped, groups in the text kept."""
    t = v.st.where("k IN (3, 11)").select("doc_id", "line_no", F.replace("text", F.lit(".5 psi"), F.lit(" .5 psi")).alias("text"))
    return t.select("doc_id", "line_no", F.regexp_replace("text", r"(^|[^0-9])\.([0-9])", "$10.$2").alias("zeros"), F.format_number(F.col("line_no") * 1237 + F.col("doc_id"), 0).alias("grouped"), F.regexp_extract_all("text", F.lit("[0-9]{1,3}(?:,[0-9]{3})+"), 0).alias("kept"))


@operator("X13", """SELECT page_key, count(*) FILTER (WHERE flow) AS flow, count(*) FILTER (WHERE NOT flow) AS rest FROM (SELECT b.page_key, b.rid, count(o.rid) >= 2 AS flow FROM bx b LEFT JOIN bx o ON o.page_key = b.page_key AND o.rid <> b.rid AND abs(o.x0 - b.x0) <= 24 AND abs(o.size - b.size) <= 1 GROUP BY b.page_key, b.rid) GROUP BY page_key""")
def flow_split(v):
    """Units of a page that flow (two others share their left edge within 24 points and their size within one) and the rest."""
    r = boxes(v)
    o = r.select(F.col("page_key").alias("op"), F.col("rid").alias("orid"), F.col("x0").alias("ox0"), F.col("size").alias("osize"))
    n = r.join(o, F.expr("page_key = op AND orid <> rid AND abs(ox0 - x0) <= 24 AND abs(osize - size) <= 1"), "left").groupBy("page_key", "rid").agg((F.count("orid") >= 2).alias("flow"))
    return n.groupBy("page_key").agg(F.count_if("flow").alias("flow"), F.count_if(~F.col("flow")).alias("rest"))


# ---------------------------------------------------------------- fixpoints


_LINES = "list_sum(list_transform(es, lambda e: ceil((e.n + 2 + length(CAST(e.base + {p} AS VARCHAR))) / 40.0)))"


@operator("L7 L8", f"""SELECT page_id, e.o AS ord, e.base + pages AS start, CAST(floor(above / 10) AS BIGINT) + 1 AS on_page, 72 + 14 * (above % 10) AS link_y, pages FROM (SELECT page_id, pages, e, CAST(coalesce(list_sum(list_transform(list_filter(es, lambda x: x.o < e.o), lambda x: ceil((x.n + 2 + length(CAST(x.base + pages AS VARCHAR))) / 40.0))), 0) AS BIGINT) AS above FROM (SELECT page_id, es, pages, unnest(es) AS e FROM (SELECT page_id, es, list_reduce([CAST(1 AS BIGINT), 1, 2, 3], lambda p, k: CAST(ceil({_LINES.format(p='p')} / 10.0) AS BIGINT)) AS pages FROM (SELECT page_id, list({{'o': ord, 'n': length(title) * 3, 'base': ord * 31 + 90}} ORDER BY ord) AS es FROM te GROUP BY page_id))))""")
def settled_contents(v):
    """A contents page laid out in three passes, as page numbers shift by the pages that the contents take and may then need more lines.

    Each entry's page number, the contents page and the height of its link.
    """
    g = v.te.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), (F.length("title") * 3).alias("n"), (F.col("ord") * 31 + 90).alias("base")))).alias("es"))
    tall = lambda e, p: F.ceil((e["n"] + 2 + F.length((e["base"] + p).cast("string"))) / F.lit(40.0))
    total = lambda es, p: F.aggregate(F.transform(es, lambda e: tall(e, p)), F.lit(0).cast("long"), lambda a, x: a + x)
    done = g.select("page_id", "es", F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(1).cast("long"), lambda p, _: F.ceil(total(F.col("es"), p) / F.lit(10.0))).alias("pages"))
    above = total(F.filter("es", lambda x: x["o"] < F.col("e.o")), F.col("pages"))
    rows = done.select("page_id", "es", "pages", F.explode("es").alias("e")).select("page_id", "e.o", "e.base", "pages", above.alias("above"))
    return rows.select("page_id", F.col("o").alias("ord"), (F.col("base") + F.col("pages")).alias("start"), (F.floor(F.col("above") / 10) + 1).alias("on_page"), (72 + 14 * (F.col("above") % 10)).alias("link_y"), "pages")


_GAP = "greatest(c.x0 - a.x1, a.x0 - c.x1, c.y0 - a.y1, a.y0 - c.y1, 0)"
_FAR = f"list_filter(cs, lambda c: {_GAP} <= 26)"
_GROW = ", ".join(f"'{c}': {f}(a.{c}, coalesce(list_{m}(list_transform({_FAR}, lambda c: c.{c})), a.{c}))" for c, f, m in (("x0", "least", "min"), ("y0", "least", "min"), ("x1", "greatest", "max"), ("y1", "greatest", "max")))


@operator("X8", f"""SELECT page_key, rid, r.x0, r.y0, r.x1, r.y1 FROM (SELECT page_key, rid, list_reduce(list_concat([own], cs), lambda a, _: {{{_GROW}}}) AS r FROM (SELECT f.page_key, f.rid, {{'x0': any_value(f.x0), 'y0': any_value(f.y0), 'x1': any_value(f.x1), 'y1': any_value(f.y1)}} AS own, list({{'x0': c.x0, 'y0': c.y0, 'x1': c.x1, 'y1': c.y1}} ORDER BY c.rid) AS cs FROM bx f JOIN bx c ON c.page_key = f.page_key AND c.size = 9 WHERE f.size = 10 GROUP BY f.page_key, f.rid))""")
def figure_extents(v):
    """A figure's box grown over every piece of art that is at most 26 points from what it has grown to, until nothing more is near."""
    r = boxes(v)
    f = r.where("size = 10").select("page_key", "rid", F.struct(*BOX).alias("own"))
    c = r.where("size = 9").groupBy("page_key").agg(F.collect_list(F.struct(*BOX)).alias("cs"))
    j = f.join(c, "page_key")

    def grow(a, _):
        gap = lambda x: F.greatest(x["x0"] - a["x1"], a["x0"] - x["x1"], x["y0"] - a["y1"], a["y0"] - x["y1"], F.lit(0.0))
        near = F.filter(F.col("cs"), lambda x: gap(x) <= 26)
        side = lambda c, pick, both: both(a[c], F.coalesce(pick(F.transform(near, lambda x: x[c])), a[c])).alias(c)
        return F.struct(side("x0", F.array_min, F.least), side("y0", F.array_min, F.least), side("x1", F.array_max, F.greatest), side("y1", F.array_max, F.greatest))

    e = j.select("page_key", "rid", F.aggregate("cs", F.col("own"), grow).alias("r"))
    return e.select("page_key", "rid", *[f"r.{c}" for c in BOX])


_FITS = "least(f.b, x[1].b) - greatest(f.a, x[1].a) > 0.55 * least(f.b - f.a, x[1].b - x[1].a) AND least(f.bottom, x[1].bottom) - greatest(f.top, x[1].top) > -6"
_UNION = "{'a': least(f.a, x[1].a), 'b': greatest(f.b, x[1].b), 'top': least(f.top, x[1].top), 'bottom': greatest(f.bottom, x[1].bottom)}"
_PASS = f"list_reduce(list_transform(SOURCE, lambda e: [e]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda f: {_FITS})) = 0 THEN list_append(acc, x[1]) ELSE list_transform(acc, lambda f, j: CASE WHEN j = list_position(list_transform(acc, lambda f: {_FITS}), true) THEN {_UNION} ELSE f END) END)"
_THRICE = _PASS.replace("SOURCE", _PASS.replace("SOURCE", _PASS.replace("SOURCE", "fs")))


@operator("C7", f"""WITH tb AS (FAMILIES), mg AS (SELECT page_key, unnest(m) AS r FROM (SELECT page_key, {_THRICE} AS m FROM (SELECT page_key, list({{'a': a, 'b': b, 'top': top, 'bottom': bottom}} ORDER BY top, a, b, bottom) AS fs FROM tb GROUP BY page_key)))
  SELECT g.page_key, r.a, r.b, r.top, r.bottom, count(*) AS words FROM mg g JOIN bx w ON w.page_key = g.page_key AND (w.x0 + w.x1) / 2 BETWEEN r.a - 2 AND r.b + 2 AND (w.y0 + w.y1) / 2 BETWEEN r.top - 2 AND r.bottom + 2 GROUP BY ALL HAVING count(*) >= 2""".replace("FAMILIES", RAW["rule_families"]))
def table_regions(v):
    """Tables: families of rules merged, in three passes, where they overlap by 55 % of the narrower and meet in height (6 points); with words."""
    fs = rule_families(v).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("top", "a", "b", "bottom"))).alias("fs"))
    start = F.filter("fs", lambda f: F.lit(False))

    def step(acc, x):
        fits = lambda f: (F.least(f["b"], x["b"]) - F.greatest(f["a"], x["a"]) > 0.55 * F.least(f["b"] - f["a"], x["b"] - x["a"])) & (F.least(f["bottom"], x["bottom"]) - F.greatest(f["top"], x["top"]) > -6)
        both = lambda f: F.struct(F.least(f["top"], x["top"]).alias("top"), F.least(f["a"], x["a"]).alias("a"), F.greatest(f["b"], x["b"]).alias("b"), F.greatest(f["bottom"], x["bottom"]).alias("bottom"))
        at = F.array_position(F.transform(acc, fits), F.lit(True))
        return F.when(at == 0, F.array_append(acc, x)).otherwise(F.transform(acc, lambda f, j: F.when(j + 1 == at, both(f)).otherwise(f)))

    merged = F.col("fs")
    for _ in range(3):
        merged = F.aggregate(merged, start, step)
    m = fs.select("page_key", F.explode(merged).alias("r")).select("page_key", "r.a", "r.b", "r.top", "r.bottom")
    w = boxes(v).select(F.col("page_key").alias("wp"), F.expr("(x0 + x1) / 2").alias("wx"), F.expr("(y0 + y1) / 2").alias("wy"))
    j = m.join(w, F.expr("page_key = wp AND wx BETWEEN a - 2 AND b + 2 AND wy BETWEEN top - 2 AND bottom + 2"))
    return j.groupBy("page_key", "a", "b", "top", "bottom").agg(F.count(F.lit(1)).alias("words")).where("words >= 2")
