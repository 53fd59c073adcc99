"""Derived columns: page metrics, levels, labels and number formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.plans.registry import operator


@operator("P2 N1 N3", """SELECT page_key, count(*) AS cells, least(100.0, count(*) * 64 / 484704.0 * 100) AS share FROM (SELECT DISTINCT page_key, cx, cy FROM (SELECT page_key, cx, unnest(range(CAST(floor(y0 / 8) AS BIGINT), CAST(floor(y1 / 8) AS BIGINT) + 1)) AS cy
  FROM (SELECT page_key, y0, y1, unnest(range(CAST(floor(x0 / 8) AS BIGINT), CAST(floor(x1 / 8) AS BIGINT) + 1)) AS cx FROM rc))) GROUP BY page_key""")
def grid_coverage(v):
    """How many cells of an 8-point grid the rectangles of a page touch, and their share of a Letter page."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 8), F.floor(F.col(b) / 8)))
    c = v.rc.select("page_key", "y0", "y1", cells("x0", "x1").alias("cx")).select("page_key", "cx", cells("y0", "y1").alias("cy")).distinct()
    return c.groupBy("page_key").agg(F.count(F.lit(1)).alias("cells")).withColumn("share", F.least(F.lit(100.0), F.col("cells") * 64 / 484704.0 * 100))


@operator("P8 P10 P26", """SELECT *, greatest(280, CAST(floor(w * scale) AS BIGINT)) AS pad_w, greatest(280, CAST(floor(h * scale) AS BIGINT)) AS pad_h FROM (SELECT xref, place_no, w, h, CASE WHEN width_pt >= 250 THEN 300 WHEN width_pt >= 120 THEN 450 ELSE 600 END AS dpi, CASE WHEN w >= 1200 THEN 'wide' ELSE 'narrow' END AS params, CASE WHEN greatest(w, h) > 1568 THEN 1568.0 / greatest(w, h) ELSE 1.0 END::DOUBLE AS scale FROM img)""", big="dpi w h")
def image_parameters(v):
    """Resolution by width, detection parameters, and the scale and padded size (280 to 1568 pixels a side) of each placement's request."""
    w, h = F.col("w"), F.col("h")
    scale = F.when(F.greatest(w, h) > 1568, 1568.0 / F.greatest(w, h)).otherwise(1.0)
    out = v.img.select("xref", "place_no", "w", "h", F.when(F.col("width_pt") >= 250, 300).when(F.col("width_pt") >= 120, 450).otherwise(600).alias("dpi"), F.when(w >= 1200, "wide").otherwise("narrow").alias("params"), scale.alias("scale"))
    return out.select("*", *[F.greatest(F.lit(280).cast("long"), F.floor(F.col(c) * F.col("scale"))).alias(f"pad_{c}") for c in ("w", "h")])


@operator("Z2", """SELECT xref, (place_no - 1) // 16 AS request, count(*) AS crops, (place_no - 1) // 16 = 0 AS whole_figure, 2 * count(*) + CASE WHEN (place_no - 1) // 16 = 0 THEN 1 ELSE 0 END AS questions FROM img GROUP BY xref, (place_no - 1) // 16""")
def figure_requests(v):
    """Questions about a figure's boxes: sixteen crops a request and two questions each; the whole figure goes with the first only."""
    g = v.img.groupBy("xref", F.floor((F.col("place_no") - 1) / 16).alias("request")).agg(F.count(F.lit(1)).alias("crops"))
    first = F.col("request") == 0
    return g.select("xref", "request", "crops", first.alias("whole_figure"), (2 * F.col("crops") + F.when(first, 1).otherwise(0)).alias("questions"))


@operator("Z4 F25", """SELECT event_id, CASE WHEN present < 0.6 THEN 'absent' WHEN conf < 0.5 THEN 'unsure' ELSE 'located' END AS state, CASE WHEN present >= 0.6 AND conf >= 0.5 THEN x END AS x, read >= 0.6 AS readable, choice >= 0.8 AS chosen FROM (SELECT event_id, CAST(least(value / 100, 1) AS DOUBLE) AS present, user_id * 37 % 100 / 100.0::DOUBLE AS conf, event_id * 13 % 600 AS x, event_id * 7 % 100 / 100.0::DOUBLE AS read, event_id * 11 % 100 / 100.0::DOUBLE AS choice FROM events)""")
def located_boxes(v):
    """A box counts only if its target is present (0.6) and the box sure (0.5); readings and choices have bounds of their own (0.6, 0.8)."""
    share = lambda c, k: F.col(c) * k % 100 / F.lit(100.0)
    e = v.events.select("event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("present"), share("user_id", 37).alias("conf"), (F.col("event_id") * 13 % 600).alias("x"), share("event_id", 7).alias("read"), share("event_id", 11).alias("choice"))
    ok = (F.col("present") >= 0.6) & (F.col("conf") >= 0.5)
    return e.select("event_id", F.when(F.col("present") < 0.6, "absent").when(F.col("conf") < 0.5, "unsure").otherwise("located").alias("state"), F.when(ok, F.col("x")).alias("x"), (F.col("read") >= 0.6).alias("readable"), (F.col("choice") >= 0.8).alias("chosen"))


LEVELS_SQL = r"""SELECT page_id, o AS ord, t[o + 1] AS title, lv[o + 2] AS level FROM (SELECT *, unnest(range(len(t))) AS o FROM (SELECT page_id, list(title ORDER BY ord) AS t, list_reduce(list([own] ORDER BY ord), lambda a, x: list_append(a, CASE WHEN x[1] < 0 THEN greatest(2, a[-1] + 1) ELSE x[1] END), [CAST(0 AS BIGINT)]) AS lv FROM (SELECT page_id, ord, title,
  CASE WHEN regexp_matches(title, '^[0-9]+(\.[0-9]+)*(\s|$)') THEN CAST(len(string_split(regexp_replace(regexp_extract(title, '^([0-9]+(?:\.[0-9]+)*)', 1), '(\.0)+$', ''), '.')) AS BIGINT) WHEN regexp_matches(title, '^\s*[图表]\s*[0-9]') THEN CAST(-1 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS own FROM te) GROUP BY page_id))"""


def levels(v):
    number = F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*)", 1)
    parts = F.size(F.split(F.regexp_replace(number, r"(\.0)+$", ""), r"\."))
    own = F.when(F.col("title").rlike(r"^[0-9]+(\.[0-9]+)*(\s|$)"), parts).when(F.col("title").rlike(r"^\s*[图表]\s*[0-9]"), -1).otherwise(1).cast("long")
    g = v.te.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", own.alias("own")))).alias("es"))
    step = lambda a, x: F.array_append(a, F.when(x["own"] < 0, F.greatest(F.lit(2).cast("long"), F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + 1)).otherwise(x["own"]))
    folded = F.aggregate("es", F.array().cast("array<bigint>"), step)
    return g.select("page_id", "es", folded.alias("lv")).select("page_id", F.explode(F.arrays_zip("es", "lv")).alias("z")).select("page_id", "z.es.ord", "z.es.title", F.col("z.lv").alias("level"))


@operator("P11", LEVELS_SQL)
def entry_levels(v):
    """The level of a contents entry: parts of its number without trailing zeros; a figure or table one deeper than the entry before; else 1."""
    return levels(v)


@operator("P12", f"SELECT page_id, CAST(o AS BIGINT) AS ord, t[o + 1] AS title, out[o + 2] AS level FROM (SELECT *, unnest(range(len(t))) AS o FROM (SELECT page_id, list(title ORDER BY ord) AS t, list_reduce(list([level] ORDER BY ord), lambda a, x: list_append(a, least(x[1], a[-1] + 1)), [CAST(0 AS BIGINT)]) AS out FROM ({LEVELS_SQL}) GROUP BY page_id))")
def outline_levels(v):
    """Outline levels of each page's entries, none more than one deeper than the entry before."""
    g = levels(v).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "level"))).alias("es"))
    step = lambda a, x: F.array_append(a, F.least(x["level"], F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + 1))
    folded = F.aggregate("es", F.array().cast("array<bigint>"), step)
    return g.select("page_id", "es", folded.alias("lv")).select("page_id", F.explode(F.arrays_zip("es", "lv")).alias("z")).select("page_id", "z.es.ord", "z.es.title", F.col("z.lv").alias("level"))


@operator("P13 O6 J29", """SELECT a.page_key, a.rid, arg_max(b.size, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) * 1000 + b.size) AS span_size,
  round(sum(CASE WHEN b.size % 2 = 0 THEN length(b.txt) ELSE 0 END) / sum(length(b.txt)), 6) AS bold_share FROM rc a JOIN rc b ON a.page_key = b.page_key AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY a.page_key, a.rid""", big="span_size")
def span_font_size(v):
    """The size of the span that overlaps each unit most (ties: the larger), and the share of bold characters under it."""
    a, b = v.rc.alias("a"), v.rc.select("page_key", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1", "size", "txt")]).alias("b")
    j = a.join(b, (F.col("a.page_key") == F.col("b.page_key")) & (F.col("x0") < F.col("bx1")) & (F.col("bx0") < F.col("x1")) & (F.col("y0") < F.col("by1")) & (F.col("by0") < F.col("y1")))
    area = (F.least("x1", "bx1") - F.greatest("x0", "bx0")) * (F.least("y1", "by1") - F.greatest("y0", "by0"))
    n = F.length("btxt")
    return j.groupBy("a.page_key", "a.rid").agg(F.max_by("bsize", F.struct(area, "bsize")).alias("span_size"), F.round(F.sum(F.when(F.col("bsize") % 2 == 0, n).otherwise(0)) / F.sum(n), 6).alias("bold_share"))


@operator("P14", """SELECT page_key, rid, CASE WHEN len(cells) = 3 THEN list_concat([CAST(row_number() OVER (PARTITION BY page_key ORDER BY rid) AS VARCHAR)], cells) ELSE cells END AS cells FROM (SELECT page_key, rid, CASE WHEN l_linenumber % 2 = 0 THEN [txt, p_brand, CAST(size AS VARCHAR)] ELSE ['x', txt, p_brand, CAST(size AS VARCHAR)] END AS cells FROM rc)""")
def numbered_rows(v):
    """Rows one cell short of their four headers get their number in front; full rows stay."""
    size = F.col("size").cast("string")
    cells = F.when(F.col("l_linenumber") % 2 == 0, F.array("txt", "p_brand", size)).otherwise(F.array(F.lit("x"), "txt", "p_brand", size))
    n = F.row_number().over(Window.partitionBy("page_key").orderBy("rid")).cast("string")
    return v.rc.select("page_key", "rid", cells.alias("cells")).select("page_key", "rid", F.when(F.size("cells") == 3, F.concat(F.array(n), F.col("cells"))).otherwise(F.col("cells")).alias("cells"))


@operator("P15", """SELECT kind, pos, text FROM (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'A' WHEN o_orderpriority LIKE '2%' THEN 'B' END AS kind, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS pos, o_orderstatus || ':' || o_orderkey AS text FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')
  UNION ALL SELECT 'C', 1, '(none)' WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority LIKE '9%')""")
def errata_sections(v):
    """Three sections of numbered rows; an empty section holds a placeholder."""
    pos = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    rows = v.orders.where("o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'").select(F.when(F.col("o_orderpriority").like("1%"), "A").otherwise("B").alias("kind"), pos.alias("pos"), F.concat("o_orderstatus", F.lit(":"), F.col("o_orderkey").cast("string")).alias("text"))
    c = v.orders.where("o_orderpriority LIKE '9%'").agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("C").alias("kind"), F.lit(1).alias("pos"), F.lit("(none)").alias("text"))
    return rows.unionByName(c)


ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")


@operator("P17", f"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN i || '.' WHEN 1 THEN chr(CAST(96 + i AS INTEGER)) || '.' WHEN 2 THEN chr(CAST(64 + i AS INTEGER)) || '.' WHEN 3 THEN {list(ROMAN)}[i] || '.' ELSE '（' || i || '）' END AS marker FROM (SELECT *, p_partkey % 20 + 1 AS i FROM part)""")
def list_markers(v):
    """List markers in five styles."""
    i = (F.col("p_partkey") % 20 + 1).cast("int")
    roman = F.element_at(F.array(*[F.lit(r) for r in ROMAN]), i)
    k = F.col("p_size") % 5
    dot = F.lit(".")
    return v.part.select("p_partkey", F.when(k == 0, F.concat(i.cast("string"), dot)).when(k == 1, F.concat(F.char(96 + i), dot)).when(k == 2, F.concat(F.char(64 + i), dot)).when(k == 3, F.concat(roman, dot)).otherwise(F.concat(F.lit("（"), i.cast("string"), F.lit("）"))).alias("marker"))


@operator("P21", """SELECT doc_id, line_no, text, x0 AS origin_x, y1 AS origin_y, size, (CAST(color AS BIGINT) >> 16) & 255 AS red, (CAST(color AS BIGINT) >> 8) & 255 AS green, CAST(color AS BIGINT) & 255 AS blue, round(degrees(atan2(0 - dy, dx)), 6) AS deg FROM st WHERE regexp_matches(font, 'WM') AND size >= 20""")
def watermark_rows(v):
    """Watermarks as rows to be set again: text, origin, size, colour channels and angle."""
    c = F.col("color").cast("long")
    channel = lambda k: F.shiftright(c, k).bitwiseAND(F.lit(255).cast("long"))
    s = v.st.where(F.col("font").rlike("WM") & (F.col("size") >= 20))
    return s.select("doc_id", "line_no", "text", F.col("x0").alias("origin_x"), F.col("y1").alias("origin_y"), "size", channel(16).alias("red"), channel(8).alias("green"), channel(0).alias("blue"), F.round(F.degrees(F.atan2(F.lit(0.0) - F.col("dy"), F.col("dx"))), 6).alias("deg"))


CORNERS = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))


@operator("G8 N4", "SELECT doc_id, line_no, " + ", ".join(f"round(x0 + ({x} - x0) * cos(t) - ({y} - y1) * sin(t), 6) AS qx{i}, round(y1 + ({x} - x0) * sin(t) + ({y} - y1) * cos(t), 6) AS qy{i}" for i, (x, y) in enumerate(CORNERS)) + ", round(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)), 6) AS diagonal FROM (SELECT *, atan2(dy, dx) AS t FROM st WHERE dy <> 0 OR dx < 0)")
def rotated_quads(v):
    """The four corners of turned lines: their box turned about its origin, the lower left corner, by the line's direction."""
    s = v.st.where("dy <> 0 OR dx < 0").withColumn("t", F.atan2("dy", "dx"))
    out = []
    for i, (x, y) in enumerate(CORNERS):
        a, b = F.col(x) - F.col("x0"), F.col(y) - F.col("y1")
        out += [F.round(F.col("x0") + a * F.cos("t") - b * F.sin("t"), 6).alias(f"qx{i}"), F.round(F.col("y1") + a * F.sin("t") + b * F.cos("t"), 6).alias(f"qy{i}")]
    return s.select("doc_id", "line_no", *out, F.round(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 6).alias("diagonal"))


@operator("P22", """SELECT nation, f.top AS mast_top, f.foot AS foot_top, f.gap AS foot_gap FROM (SELECT s_nationkey AS nation, list_reduce(list({'top': y_top, 'bleed': bleed, 'foot': bottom, 'gap': gap} ORDER BY s_suppkey), lambda a, d: {'top': CASE WHEN d.top IS NULL THEN a.top WHEN d.bleed THEN greatest(a.top, d.top + 20) ELSE least(a.top, d.top) END, 'bleed': false, 'foot': CASE WHEN d.top IS NULL AND d.foot > a.foot THEN d.foot ELSE a.foot END, 'gap': CASE WHEN d.top IS NULL AND d.foot > a.foot THEN d.gap ELSE a.gap END}, {'top': 40.0::DOUBLE, 'bleed': false, 'foot': 30.0::DOUBLE, 'gap': 6.0::DOUBLE}) AS f
  FROM (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 60 AS DOUBLE) END AS y_top, s_suppkey % 3 = 1 AS bleed, CAST(s_suppkey % 17 + s_suppkey % 29 AS DOUBLE) AS bottom, CAST(s_suppkey % 5 AS DOUBLE) AS gap FROM supplier) GROUP BY s_nationkey)""", big="nation")
def effective_geometry(v):
    """Page geometry after its decorations, in order: one at the top moves the head (full bleeds down, others up), one at the foot raises the foot."""
    k = F.col("s_suppkey")
    dbl = lambda c: c.cast("double")
    d = v.supplier.select("s_nationkey", k, F.when(k % 3 != 0, dbl(k % 60)).alias("y_top"), (k % 3 == 1).alias("bleed"), dbl(k % 17 + k % 29).alias("bottom"), dbl(k % 5).alias("gap"))
    g = d.groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "y_top", "bleed", "bottom", "gap"))).alias("ds"))
    start = F.struct(F.lit(40.0).alias("top"), F.lit(30.0).alias("foot"), F.lit(6.0).alias("gap"))

    def step(a, x):
        lower = x["y_top"].isNull() & (x["bottom"] > a["foot"])
        top = F.when(x["y_top"].isNull(), a["top"]).when(x["bleed"], F.greatest(a["top"], x["y_top"] + 20)).otherwise(F.least(a["top"], x["y_top"]))
        return F.struct(top.alias("top"), F.when(lower, x["bottom"]).otherwise(a["foot"]).alias("foot"), F.when(lower, x["gap"]).otherwise(a["gap"]).alias("gap"))

    f = g.select("nation", F.aggregate("ds", start, step).alias("f"))
    return f.select("nation", F.col("f.top").alias("mast_top"), F.col("f.foot").alias("foot_top"), F.col("f.gap").alias("foot_gap"))


@operator("W15", "SELECT doc_id, page, line_no, 72 + CAST(sum(CASE WHEN text = '' THEN 6 ELSE 12 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS BIGINT) AS bottom FROM ln", big="line_no")
def running_layout(v):
    """Lines placed one under the other, blank ones half as high."""
    h = F.sum(F.when(F.col("text") == "", 6).otherwise(12)).over(Window.partitionBy("doc_id", "page").orderBy("line_no"))
    return v.ln.select("doc_id", "page", "line_no", (72 + h).alias("bottom"))


@operator("P23 P24 T31", """SELECT l_orderkey, rid, regexp_extract(note, 'fin ([0-9]+)', 1) AS fin, regexp_extract(note, 'ang ([0-9]+)', 1) AS ang, regexp_extract_all(note, '[.]([0-9]+)', 1) AS decimals, nullif(regexp_extract(note, '([0-9]+/[0-9]+)', 1), '') AS frac,
  list_filter([nullif(regexp_extract(note, 'fin [0-9]+', 0), ''), nullif(regexp_extract(note, 'tir [0-9]+', 0), '')], lambda x: x IS NOT NULL) AS blocks FROM (SELECT page_key AS l_orderkey, rid, 'fin ' || CAST(l_quantity AS INTEGER) || ' ang ' || size || ' .' || l_linenumber || ' .0' || size || CASE WHEN l_linenumber % 2 = 0 THEN ' ' || size || '/8' ELSE ' tir ' || size END AS note FROM rc)""")
def note_parse(v):
    """Notes taken apart by pattern, and the parts that are there as blocks."""
    s = lambda c: F.col(c).cast("int").cast("string")
    tail = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), s("size"), F.lit("/8"))).otherwise(F.concat(F.lit(" tir "), s("size")))
    note = v.rc.select(F.col("page_key").alias("l_orderkey"), "rid", F.concat(F.lit("fin "), s("l_quantity"), F.lit(" ang "), s("size"), F.lit(" ."), s("l_linenumber"), F.lit(" .0"), s("size"), tail).alias("note"))
    g = lambda p, i=1: F.regexp_extract("note", p, i)
    none = lambda c: F.nullif(c, F.lit(""))
    return note.select("l_orderkey", "rid", g("fin ([0-9]+)").alias("fin"), g("ang ([0-9]+)").alias("ang"), F.regexp_extract_all("note", F.lit("[.]([0-9]+)"), 1).alias("decimals"), none(g("([0-9]+/[0-9]+)")).alias("frac"), F.array_compact(F.array(none(g("fin [0-9]+", 0)), none(g("tir [0-9]+", 0)))).alias("blocks"))


@operator("P25 P27", """SELECT page_key, rid, greatest(0, x0 - pad) AS cx0, greatest(0, y0 - pad) AS cy0, least(612, x1 + pad) AS cx1, least(792, y1 + pad) AS cy1, least(1, greatest(0, (x0 - 5) / 290)) AS u0, least(1, greatest(0, (y0 - 5) / 190)) AS v0, least(1, greatest(0, (x1 - 5) / 290)) AS u1, least(1, greatest(0, (y1 - 5) / 190)) AS v1,
  round(5 + 290 * least(1, greatest(0, (x0 - 5) / 290)), 6) AS back_x0, round(5 + 190 * least(1, greatest(0, (y0 - 5) / 190)), 6) AS back_y0, round(5 + 290 * least(1, greatest(0, (x1 - 5) / 290)), 6) AS back_x1, round(5 + 190 * least(1, greatest(0, (y1 - 5) / 190)), 6) AS back_y1 FROM (SELECT *, greatest(12, 0.6 * greatest(x1 - x0, y1 - y0)) AS pad FROM rc)""")
def padded_boxes(v):
    """Padded crop boxes clamped to the page, and each box in the unit square of a region (clamped to it) and back in points."""
    pad = F.greatest(F.lit(12.0), 0.6 * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    r, zero = v.rc.withColumn("pad", pad), F.lit(0.0)
    unit = {c: F.least(F.lit(1.0), F.greatest(zero, (F.col(c) - 5) / (290 if c[0] == "x" else 190))) for c in ("x0", "y0", "x1", "y1")}
    return r.select("page_key", "rid", F.greatest(zero, F.col("x0") - F.col("pad")).alias("cx0"), F.greatest(zero, F.col("y0") - F.col("pad")).alias("cy0"), F.least(F.lit(612.0), F.col("x1") + F.col("pad")).alias("cx1"), F.least(F.lit(792.0), F.col("y1") + F.col("pad")).alias("cy1"), *[e.alias(c.replace("x", "u").replace("y", "v")) for c, e in unit.items()], *[F.round(5 + (290 if c[0] == "x" else 190) * e, 6).alias(f"back_{c}") for c, e in unit.items()])


@operator("G11", """SELECT f.page_key, f.rid, least(any_value(f.y1) + 20, coalesce(min(c.y0) - 4.5, 1e9)) AS bottom, count(c.rid) AS captions FROM rc f LEFT JOIN rc c ON c.page_key = f.page_key AND c.rid <> f.rid AND c.size = 6 AND c.y0 >= f.y1 AND least(f.x1, c.x1) > greatest(f.x0, c.x0) WHERE f.size >= 9 GROUP BY f.page_key, f.rid""")
def caption_clamp(v):
    """The lower edge of a figure's crop, 20 points further down but 4.5 short of the first caption below."""
    f = v.rc.where("size >= 9").select("page_key", "rid", "x0", "x1", "y1")
    c = v.rc.where("size = 6").select(F.col("page_key").alias("cp"), F.col("rid").alias("crid"), F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), F.col("y0").alias("cy0"))
    j = f.join(c, F.expr("page_key = cp AND crid <> rid AND cy0 >= y1 AND least(x1, cx1) > greatest(x0, cx0)"), "left")
    return j.groupBy("page_key", "rid", "y1").agg(F.min("cy0").alias("first"), F.count("crid").alias("captions")).select("page_key", "rid", F.least(F.col("y1") + 20, F.coalesce(F.col("first") - 4.5, F.lit(1e9))).alias("bottom"), "captions")
