"""Scans and sources, sinks and dumps over the layout relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.plans.registry import operator


@operator("S2 S9 R1 D2", "SELECT doc_id, page, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_spans, max(n) AS most FROM (SELECT doc_id, page, line_no, count(*) AS n FROM wd GROUP BY ALL) GROUP BY doc_id, page")
def nested_spans(v):
    """The page tree at rest (lines with arrays of spans), opened again; blank spans and empty lines are gone."""
    tree = v.wd.groupBy("doc_id", "page", "line_no").agg(F.collect_list(F.struct("word_no", "w", "x0", "x1")).alias("spans")).groupBy("doc_id", "page").agg(F.collect_list(F.struct("line_no", "spans")).alias("lines"))
    lines = tree.select("doc_id", "page", F.explode("lines").alias("l")).select("doc_id", "page", "l.line_no", F.explode("l.spans").alias("s")).groupBy("doc_id", "page", "line_no").agg(F.count("s.w").alias("n"))
    return lines.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_spans"), F.max("n").alias("most"))


@operator("S5 P9 O6 D11", "SELECT xref, min(w) AS w, min(h) AS h, count(*) AS places, round(min(w) / max(width_pt) * 72, 6) AS eff_dpi, arg_min(page, place_no) AS first_page FROM img GROUP BY xref", big="w h")
def image_manifest(v):
    """One row an image with its placements and effective resolution at the widest one."""
    g = v.img.groupBy("xref").agg(F.min("w").alias("w"), F.min("h").alias("h"), F.count(F.lit(1)).alias("places"), F.max("width_pt").alias("m"), F.min_by("page", "place_no").alias("first_page"))
    return g.select("xref", "w", "h", "places", F.round(F.col("w") / F.col("m") * 72, 6).alias("eff_dpi"), "first_page")


@operator("S8", "SELECT page_key, rid FROM rc WHERE (x1 - x0) / 4 BETWEEN 3 AND 11 AND (y1 - y0) BETWEEN 3 AND 11 AND abs((x1 - x0) / 4 - (y1 - y0)) < 3")
def checkbox_scan(v):
    """Nearly square small rectangles (widths in quarter units)."""
    w, h = (F.col("x1") - F.col("x0")) / 4, F.col("y1") - F.col("y0")
    return v.rc.where(w.between(3, 11) & h.between(3, 11) & (F.abs(w - h) < 3)).select("page_key", "rid")


@operator("S11 O1", "SELECT doc_id, page, string_agg(w, ' ' ORDER BY y0, x0) AS text FROM wd GROUP BY doc_id, page")
def reading_order(v):
    """All words of a page, joined in reading order."""
    g = v.wd.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "w"))).alias("ws"))
    return g.select("doc_id", "page", F.array_join(F.col("ws.w"), " ").alias("text"))


@operator("S12 A12 A2", "SELECT page, size, n FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, size) AS rn FROM (SELECT page, size, CAST(sum(length(text)) AS BIGINT) AS n FROM un GROUP BY page, size)) WHERE rn = 1", big="size")
def dominant_size(v):
    """The size with most characters on each page; ties go to the smaller size."""
    g = v.un.groupBy("page", "size").agg(F.sum(F.length("text")).alias("n"))
    return g.groupBy("page").agg(F.min_by(F.struct("size", "n"), F.struct(-F.col("n"), "size")).alias("m")).select("page", "m.size", "m.n")


@operator("S14", "SELECT doc_id, page, list(text ORDER BY line_no) AS header FROM ln WHERE y0 < 130 AND trim(text, ' ') <> '' GROUP BY doc_id, page")
def header_lines(v):
    """The lines in the head band of each page, in order."""
    g = v.ln.where("y0 < 130 AND trim(text) <> ''").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("text").alias("t")))).alias("h"))
    return g.select("doc_id", "page", F.col("h.t").alias("header"))


@operator("S16 W2", "SELECT text, min(page) AS first_page, count(*) AS n FROM un GROUP BY text")
def units_first_page(v):
    """Distinct units with the first page that shows them."""
    return v.un.groupBy("text").agg(F.min("page").alias("first_page"), F.count(F.lit(1)).alias("n"))


@operator("K7", """SELECT stem, max(name) AS latest, stem || '_v' || lpad(CAST(max(v) + 1 AS VARCHAR), 2, '0') AS next FROM (SELECT p_brand AS stem, p_size AS v, p_brand || '_v' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS name FROM part) GROUP BY stem""")
def latest_versions(v):
    """The last version of each stem by name, and the name the next one gets."""
    p = v.part.select(F.col("p_brand").alias("stem"), F.col("p_size").alias("v"), F.concat("p_brand", F.lit("_v"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("name"))
    return p.groupBy("stem").agg(F.max("name").alias("latest"), F.concat("stem", F.lit("_v"), F.lpad((F.max("v") + 1).cast("string"), 2, "0")).alias("next"))


@operator("S19 J1 D15", "SELECT key, batch, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY batch) AS rn FROM dk WHERE value IS NOT NULL) WHERE rn = 1", big="batch")
def dictionary_priority(v):
    """The value of each key: the first batch that has one; an empty one counts, null doesn't."""
    return first_values(v).select("key", "batch", "value")


def first_values(v):
    return v.dk.where("value IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("batch", "value"), "batch").alias("m")).select("key", "m.batch", "m.value")


@operator("S23 A4 O4", """SELECT edge, x, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY n DESC, x) AS rn FROM (SELECT 'left' AS edge, x0 AS x, count(*) AS n FROM rc GROUP BY x0 UNION ALL SELECT 'right', x1, count(*) FROM rc GROUP BY x1)) WHERE rn <= 5""")
def edge_survey(v):
    """The five most frequent left and right edges."""
    e = v.rc.select(F.explode(F.array(F.struct(F.lit("left").alias("edge"), F.col("x0").alias("x")), F.struct(F.lit("right").alias("edge"), F.col("x1").alias("x")))).alias("e")).groupBy("e.edge", "e.x").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("edge").orderBy(F.desc("n"), "x"))).where("rn <= 5")


@operator("S24 O2 N2", """SELECT s_suppkey, list(DISTINCT p ORDER BY p) AS pages FROM (SELECT s_suppkey, unnest(range(CAST(split_part(part, '-', 1) AS BIGINT), CAST(CASE WHEN part LIKE '%-%' THEN split_part(part, '-', 2) ELSE part END AS BIGINT) + 1)) AS p
  FROM (SELECT s_suppkey, unnest(string_split(s_nationkey || '-' || (s_nationkey + 3) || ',' || (s_suppkey % 30), ',')) AS part FROM supplier)) WHERE p BETWEEN 1 AND 20 GROUP BY s_suppkey""")
def page_ranges(v):
    """Page lists of specifications like "4-7,12", clipped to pages 1 to 20."""
    spec = F.concat_ws("", F.col("s_nationkey").cast("string"), F.lit("-"), (F.col("s_nationkey") + 3).cast("string"), F.lit(","), (F.col("s_suppkey") % 30).cast("string"))
    part = v.supplier.select("s_suppkey", F.explode(F.split(spec, ",")).alias("part"))
    lo, hi = F.split_part("part", F.lit("-"), F.lit(1)).cast("long"), F.when(F.col("part").contains("-"), F.split_part("part", F.lit("-"), F.lit(2))).otherwise(F.col("part")).cast("long")
    p = part.select("s_suppkey", F.explode(F.sequence(lo, hi)).alias("p")).where("p BETWEEN 1 AND 20")
    return p.groupBy("s_suppkey").agg(F.array_sort(F.collect_set("p")).alias("pages"))


@operator("S22 K1 D12 Q1 Q2 M3", """SELECT l_orderkey AS page, 'box' || (rid - 1) AS stem, CAST(rid - 1 AS BIGINT) AS box, CAST(x0 AS BIGINT) AS left_edge FROM (SELECT page_key AS l_orderkey, rid, x0 FROM rc)""")
def detection_boxes(v):
    """Boxes written as one JSON map a page and read back: position in the map's arrays is the box id."""
    j = v.rc.groupBy("page_key").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rid", "x0", "y0", "x1", "y1"))), lambda b: F.struct(F.concat(F.lit("box"), (b["rid"] - 1).cast("string")).alias("key"), F.array(b["x0"], b["y0"], b["x1"], b["y1"]).alias("value"))))).alias("j"))
    m = j.select("page_key", F.explode(F.from_json("j", "map<string,array<double>>")).alias("stem", "box"))
    return m.select(F.col("page_key").alias("page"), "stem", F.regexp_extract("stem", r"(\d+)$", 1).cast("long").alias("box"), F.col("box")[0].cast("long").alias("left_edge"))


@operator("K2", """SELECT doc_id, page, '=== page ' || page || ' (' || count(*) || ' lines) ===' || chr(10) || string_agg('[' || lpad(CAST(line_no AS VARCHAR), 4, '0') || '] ' || text, chr(10) ORDER BY line_no) AS dump FROM ln GROUP BY doc_id, page""")
def text_dump(v):
    """A readable dump of each page under a header line."""
    line = F.concat(F.lit("["), F.lpad(F.col("line_no").cast("string"), 4, "0"), F.lit("] "), "text")
    g = v.ln.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("t")))).alias("ls"))
    return g.select("doc_id", "page", F.concat(F.format_string("=== page %d (%d lines) ===\n", "page", F.size("ls")), F.array_join(F.col("ls.t"), "\n")).alias("dump"))


@operator("K3 J2 O3 F1 F2 T1 Y10 E2 E8", """SELECT text, first_page, n FROM (SELECT text, min(page) AS first_page, count(*) AS n FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, page FROM un) GROUP BY text) u
  WHERE NOT (regexp_full_match(text, '[0-9[:punct:]\\s]*') OR (regexp_full_match(text, '[A-Z0-9][A-Z0-9./-]*') AND regexp_matches(text, '[0-9]')) OR regexp_full_match(text, '[0-9]+/[0-9]+') OR NOT regexp_matches(text, '[A-Za-z]{2}'))
  AND NOT EXISTS (SELECT 1 FROM dk WHERE dk.key = u.text AND dk.value IS NOT NULL)""")
def pending_keys(v):
    """Units that are neither kept as they are nor found in the dictionary, by first page and then length."""
    t = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    units = v.un.groupBy(t.alias("text")).agg(F.min("page").alias("first_page"), F.count(F.lit(1)).alias("n"))
    keys = v.dk.where("value IS NOT NULL").select(F.col("key").alias("text")).distinct()
    return units.where(~kept("text")).join(keys, "text", "left_anti").orderBy("first_page", F.length("text"), "text")


def kept(c: str):
    """Text that stays as it is: punctuation and digits, codes with a digit, fractions, or nothing like a word."""
    t = F.col(c)
    return t.rlike(r"^[0-9\p{Punct}\s]*$") | (t.rlike(r"^[A-Z0-9][A-Z0-9./-]*$") & t.rlike("[0-9]")) | t.rlike("^[0-9]+/[0-9]+$") | ~t.rlike("[A-Za-z]{2}")


@operator("K5 Q34", "SELECT o_orderkey, CASE WHEN after > 0.5 * before AND after > 2000000 THEN 'fallback' ELSE 'subset' END AS verdict, after > 20 * before AND after > 3000000 AS blown_up FROM (SELECT o_orderkey, o_totalprice * 8 AS before, o_totalprice * 8 * (o_orderkey % 30) AS after FROM orders)")
def size_decision(v):
    """Whether a subset file is kept or falls back (over half the size and 2 MB), and whether a file has grown 20 times beyond 3 MB."""
    o = v.orders.select("o_orderkey", (F.col("o_totalprice") * 8).alias("before"), (F.col("o_totalprice") * 8 * (F.col("o_orderkey") % 30)).alias("after"))
    return o.select("o_orderkey", F.expr("CASE WHEN after > 0.5 * before AND after > 2000000 THEN 'fallback' ELSE 'subset' END").alias("verdict"), F.expr("after > 20 * before AND after > 3000000").alias("blown_up"))


@operator("K4", """SELECT page, '--- page ' || page || chr(10) || string_agg(unit_no || chr(9) || text, chr(10) ORDER BY unit_no) AS dump FROM un GROUP BY page""")
def unit_dump(v):
    """The units of each page under its header, one a line with their number."""
    u = v.un.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("unit_no", "text"))).alias("us"))
    lines = F.array_join(F.transform("us", lambda x: F.concat(x["unit_no"].cast("string"), F.lit("\t"), x["text"])), "\n")
    return u.select("page", F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit("\n"), lines).alias("dump"))


@operator("K6 W5", """SELECT s_suppkey, p0 + i AS page, 'A-' || (i + 1) AS label FROM (SELECT s_suppkey, p0, unnest(range(0, pages)) AS i FROM (SELECT s_suppkey, s_nationkey % 4 + 1 AS pages, 100 + coalesce(sum(s_nationkey % 4 + 1) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM supplier))""", big="page")
def appendix_pages(v):
    """Appendices of a book (here a nation) appended one behind the other from page 100 on, each page with its label."""
    n = F.col("s_nationkey") % 4 + 1
    p0 = 100 + F.coalesce(F.sum(n).over(Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = v.supplier.select("s_suppkey", p0.alias("p0"), n.alias("pages"))
    return placed.select("s_suppkey", "p0", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("i")).select("s_suppkey", (F.col("p0") + F.col("i")).alias("page"), F.concat(F.lit("A-"), (F.col("i") + 1).cast("string")).alias("label"))


@operator("M2 Y13", "SELECT key, coalesce(arg_min(value, batch), '(new)') AS value, min(batch) AS batch FROM dk GROUP BY key", big="batch")
def merged_manifest(v):
    """A manifest merged by key: rows that are there stay, missing ones are added."""
    return v.dk.groupBy("key").agg(F.coalesce(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("batch"))), F.lit("(new)")).alias("value"), F.min("batch").alias("batch"))


@operator("K9", "SELECT xref, place_no, (place_no - 1) // 40 AS sheet, ((place_no - 1) % 40) // 5 AS tile_row, (place_no - 1) % 5 AS tile_col FROM img")
def tile_coords(v):
    """Where each placement stands on contact sheets of 40 tiles, 5 to a row."""
    k = F.col("place_no") - 1
    return v.img.select("xref", "place_no", F.floor(k / 40).alias("sheet"), F.floor(k % 40 / 5).alias("tile_row"), (k % 5).alias("tile_col"))
