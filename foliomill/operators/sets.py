"""Set operations, sampling, sorting and collection functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.plans.registry import operator


@operator("U1", """SELECT page_key, rid, 'grid' AS src FROM rc WHERE size >= 9 UNION ALL SELECT f.page_key, f.rid, 'finder' FROM rc f WHERE f.size = 8 AND NOT EXISTS (SELECT 1 FROM rc g WHERE g.page_key = f.page_key AND g.size >= 9 AND g.x0 < f.x1 AND f.x0 < g.x1 AND g.y0 < f.y1 AND f.y0 < g.y1)""")
def table_rect_union(v):
    """Grid rectangles and those finder rectangles that meet none of them."""
    grid, f = v.rc.where("size >= 9"), v.rc.where("size = 8").select("page_key", "rid", "x0", "y0", "x1", "y1")
    b = grid.select(F.col("page_key").alias("pk"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    meets = (f.page_key == b.pk) & (F.col("bx0") < F.col("x1")) & (F.col("x0") < F.col("bx1")) & (F.col("by0") < F.col("y1")) & (F.col("y0") < F.col("by1"))
    return grid.select("page_key", "rid", F.lit("grid").alias("src")).unionByName(f.join(b, meets, "left_anti").select("page_key", "rid", F.lit("finder").alias("src")))


@operator("U5", "SELECT page, txt, bx, yb, rid FROM (SELECT page_key // 16 AS page, txt, CAST(round_even(x0 / 3, 0) AS BIGINT) AS bx, CAST(round_even(y0 / 3, 0) AS BIGINT) AS yb, rid, row_number() OVER (PARTITION BY page_key // 16, txt, round_even(x0 / 3, 0), round_even(y0 / 3, 0) ORDER BY size DESC, page_key, rid) AS rn FROM rc) WHERE rn = 1")
def rect_dedupe_bucket(v):
    """Overprinted texts of one 3-point cell once, the largest kept."""
    b = lambda c: F.bround(F.col(c) / 3, 0).cast("long")
    r = v.rc.select(F.floor(F.col("page_key") / 16).alias("page"), "page_key", "txt", b("x0").alias("bx"), b("y0").alias("yb"), "rid", "size")
    return r.groupBy("page", "txt", "bx", "yb").agg(F.min_by("rid", F.struct(-F.col("size"), "page_key", "rid")).alias("rid"))


@operator("U6", "SELECT s_suppkey, list_sort(list_filter(range(1, 11), lambda p: p <> s_nationkey % 10 + 1 AND p <> s_suppkey % 10 + 1)) AS body FROM supplier")
def body_pages(v):
    """Pages 1 to 10 without the excluded ones."""
    return v.supplier.select("s_suppkey", F.array_except(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long")), F.array((F.col("s_nationkey") % 10 + 1).cast("long"), F.col("s_suppkey") % 10 + 1)).alias("body"))


@operator("U7 Y3", """SELECT page, text, side, CAST(count(*) AS BIGINT) AS n FROM ((SELECT page, text, 'lost' AS side FROM un WHERE kind <> 3 EXCEPT ALL SELECT page, text, 'lost' FROM un WHERE size > 7) UNION ALL (SELECT page, text, 'new' FROM un WHERE size > 7 EXCEPT ALL SELECT page, text, 'new' FROM un WHERE kind <> 3)) GROUP BY page, text, side""")
def two_way_difference(v):
    """Rows of either extraction that the other lacks, as multisets."""
    a, b = v.un.where("kind <> 3").select("page", "text"), v.un.where("size > 7").select("page", "text")
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new"))).groupBy("page", "text", "side").agg(F.count(F.lit(1)).alias("n"))


@operator("O2", "SELECT doc_id, page, step FROM (SELECT doc_id, page, CAST(ceil(max(page) OVER (PARTITION BY doc_id) / 80.0) AS BIGINT) AS step FROM (SELECT doc_id, page * 60 + CAST(s AS BIGINT) AS page FROM pg, range(0, 60) t(s))) WHERE (page - 1) % step = 0")
def systematic_sample(v):
    """Every n-th page, so that about eighty of a document are looked at; each stored page stands for sixty."""
    step = F.ceil(F.max("page").over(Window.partitionBy("doc_id")) / 80.0)
    sheets = v.pg.select("doc_id", (F.col("page").cast("long") * 60).alias("first")).select("doc_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.lit(59).cast("long"))).alias("page"))
    return sheets.select("doc_id", "page", step.alias("step")).where("(page - 1) % step = 0")


@operator("O5 W6", "SELECT gate, page_key, n FROM (SELECT 'size ' || size AS gate, page_key, count(*) OVER (PARTITION BY size) AS n, row_number() OVER (PARTITION BY size ORDER BY page_key, rid) AS rn FROM rc WHERE l_quantity > 45) WHERE rn <= 6")
def capped_details(v):
    """Six details of each finding, with the full count."""
    w = Window.partitionBy("size")
    r = v.rc.where("l_quantity > 45").select(F.concat(F.lit("size "), F.col("size").cast("string")).alias("gate"), "page_key", F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(w.orderBy("page_key", "rid")).alias("rn"))
    return r.where("rn <= 6").drop("rn")


@operator("R3 R4 R5 Q8 D8", """SELECT page_key, list_sum(list_transform(range(1, len(xs) + 1), lambda i: xs[i] * i)) AS weighted, xs[1:3] AS head, list_concat(xs[1:1], xs[len(xs):]) AS ends FROM (SELECT page_key, list(x0 ORDER BY x0, rid) AS xs FROM rc GROUP BY page_key)""")
def array_functions(v):
    """Zipping, numbering, slicing and concatenating sorted values."""
    xs = F.transform(F.array_sort(F.collect_list(F.struct("x0", "rid"))), lambda s: s["x0"])
    r = v.rc.groupBy("page_key").agg(xs.alias("xs"))
    n = F.size("xs")
    return r.select("page_key", F.aggregate(F.transform("xs", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("weighted"), F.slice("xs", F.lit(1), F.least(n, F.lit(3))).alias("head"), F.flatten(F.array(F.slice("xs", 1, 1), F.slice("xs", n, F.lit(1)))).alias("ends"))


@operator("M1 M2 M3 D16", "SELECT page_key, size, count(*) AS n, list(txt ORDER BY rid) AS texts FROM rc GROUP BY page_key, size", big="size")
def grouped_lists(v):
    """Lists by key in order, through a map and back."""
    r = v.rc.groupBy("page_key", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("rid", "txt"))), lambda s: s["txt"]).alias("texts"))
    m = r.groupBy("page_key").agg(F.map_from_entries(F.collect_list(F.struct("size", "texts"))).alias("m")).select("page_key", F.explode("m").alias("size", "texts"))
    return m.select("page_key", "size", F.size("texts").cast("long").alias("n"), "texts")


@operator("Q1 T28", """SELECT event_id, json_extract_string(props, '$.k') AS k, octet_length(encode(props)) AS bytes, 4 * ceil(octet_length(encode(props)) * 400000 / 3.0) <= 33554432 AS fits, base64(encode(event_type)) AS b64 FROM events""")
def json_and_base64(v):
    """A JSON path, the byte length and base64 of event records, and whether a request of 400 000 such fits 32 MiB as base64."""
    return v.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.octet_length("props").cast("long").alias("bytes"), (4 * F.ceil(F.octet_length("props") * F.lit(400000).cast("long") / F.lit(3.0)) <= 33554432).alias("fits"), F.base64(F.encode("event_type", "UTF-8")).alias("b64"))
