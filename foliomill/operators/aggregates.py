"""Aggregates: histograms, tie-stable modes, upper medians, spreads and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.operators.filters import KEEP_SQL
from foliomill.operators.projections import LEVELS_SQL, levels
from foliomill.operators.scans import kept
from foliomill.plans.registry import operator


def upper_median(c):
    """The middle value of sorted values, the upper one of two."""
    x = F.array_sort(F.collect_list(c))
    return F.get(x, F.floor(F.size(x) / 2).cast("int"))


@operator("A5 C5", "SELECT page_key, min(x) - 2 AS lo, max(x) + 2 AS hi FROM (SELECT page_key, x0 AS x, count(*) AS n FROM (SELECT l_orderkey // 16 AS page_key, CAST(l_partkey % 300 AS DOUBLE) AS x0 FROM lineitem) GROUP BY page_key, x0 HAVING count(*) >= 2) GROUP BY page_key")
def revision_bar_band(v):
    """The band of left edges that occur at least twice on a page."""
    x = v.lineitem.select(F.floor(F.col("l_orderkey") / 16).alias("page_key"), (F.col("l_partkey") % 300).cast("double").alias("x"))
    return x.groupBy("page_key", "x").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("page_key").agg((F.min("x") - 2).alias("lo"), (F.max("x") + 2).alias("hi"))


@operator("A9 Q32", "SELECT key, count(*) AS n, list(batch ORDER BY batch) AS batches FROM (SELECT key, CAST(batch AS INTEGER) AS batch FROM dk WHERE value IS NOT NULL) GROUP BY key HAVING count(*) > 1")
def dictionary_duplicates(v):
    """Keys that more than one batch defines."""
    return v.dk.where("value IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("batch")).alias("batches")).where("n > 1")


@operator("A10 N7", f"""SELECT doc_id, count(*) AS units, count(*) FILTER (WHERE {KEEP_SQL}) AS kept, count(*) FILTER (WHERE hit) AS hits, CAST(sum(length(text)) AS BIGINT) AS chars, round(100.0 * count(*) FILTER (WHERE hit) / greatest(count(*), 1), 4) AS percent, format('{{:,}}', CAST(sum(length(text)) AS BIGINT)) AS shown FROM (SELECT un.*, d.key IS NOT NULL AS hit FROM un LEFT JOIN (SELECT DISTINCT key FROM dk WHERE value IS NOT NULL) d ON d.key = un.text) GROUP BY doc_id""")
def hit_statistics(v):
    """Units, kept ones, dictionary hits, characters (also as shown, in groups of thousands) and the hit percentage of each document."""
    d = v.dk.where("value IS NOT NULL").select(F.col("key").alias("text")).distinct().withColumn("hit", F.lit(True))
    u = v.un.join(d, "text", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(kept("text")).alias("kept"), F.count_if("hit").alias("hits"), F.sum(F.length("text")).alias("chars"), F.round(100.0 * F.count_if("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("percent"), F.format_number(F.sum(F.length("text")), 0).alias("shown"))


@operator("A13 A29", "SELECT page_key, list_sort(list(y1 - y0))[len(list(y1 - y0)) // 2 + 1] AS mid_height, least(52, greatest(14, 0.88 * list_sort(list_filter(list(y1 - y0), lambda h: h <= 1.7 * list_sort(list(y1 - y0))[len(list(y1 - y0)) // 2 + 1]))[len(list_filter(list(y1 - y0), lambda h: h <= 1.7 * list_sort(list(y1 - y0))[len(list(y1 - y0)) // 2 + 1])) // 2 + 1])) AS label_size FROM rc GROUP BY page_key")
def upper_median_height(v):
    """The upper median of heights, and the label size: 0.88 of that of the heights up to 1.7 times it, from 14 to 52."""
    hs = F.array_sort(F.collect_list(F.col("y1") - F.col("y0")))
    middle = lambda x: F.get(x, F.floor(F.size(x) / 2).cast("int"))
    m = v.rc.groupBy("page_key").agg(hs.alias("hs")).withColumn("mid_height", middle(F.col("hs"))).withColumn("usual", F.filter("hs", lambda h: h <= 1.7 * F.col("mid_height")))
    return m.select("page_key", "mid_height", F.least(F.lit(52.0), F.greatest(F.lit(14.0), 0.88 * middle(F.col("usual")))).alias("label_size"))


@operator("A15 Q25", "SELECT page_key, c, max(x1) - min(x1) AS spread, count(*) AS n, max(x1) - min(x1) > 2 AS off FROM (SELECT *, sum(CASE WHEN x0 - px > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY page_key ORDER BY x0, rid) AS c FROM (SELECT *, lag(x0) OVER (PARTITION BY page_key ORDER BY x0, rid) AS px FROM rc)) GROUP BY page_key, c HAVING count(*) >= 3", big="c")
def column_alignment(v):
    """The spread of right edges in columns of left edges that lie within 20 points of the one before; over 2 points is a fault."""
    w = Window.partitionBy("page_key").orderBy("x0", "rid")
    r = v.rc.withColumn("new", F.when(F.col("x0") - F.lag("x0").over(w) > 20, 1).otherwise(0)).withColumn("c", F.sum("new").over(w))
    return r.groupBy("page_key", "c").agg((F.max("x1") - F.min("x1")).alias("spread"), F.count(F.lit(1)).alias("n")).where("n >= 3").withColumn("off", F.col("spread") > 2)


@operator("Y12", """SELECT page_id, links, bookmarks, links = 2 * bookmarks AS same FROM (SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=')) AS links, len(regexp_extract_all(html, '<(h[1-6]|li)[ >]')) AS bookmarks FROM pages)""")
def bookmark_fingerprint(v):
    """Whether links were made once only: twice as many as bookmarks, which are a page's headings and list items."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return v.pages.select("page_id", n("<a [^>]*href=").alias("links"), n("<(h[1-6]|li)[ >]").alias("bookmarks")).withColumn("same", F.col("links") == 2 * F.col("bookmarks"))


@operator("A16 Q26", "SELECT page_id, level, count(*) AS n, max(x) - min(x) AS spread, max(x) - min(x) > 2 AS off FROM (SELECT page_id, level, 54.0::DOUBLE + 12 * level + CASE WHEN ord % 11 = 5 THEN 3 ELSE 0 END AS x FROM (LEVELS)) GROUP BY page_id, level".replace("LEVELS", LEVELS_SQL))
def level_lefts(v):
    """The spread of left edges of a contents page's entries of one level; over 2 points is a fault."""
    x = 54.0 + 12 * F.col("level") + F.when(F.col("ord") % 11 == 5, 3).otherwise(0)
    g = levels(v).withColumn("x", x).groupBy("page_id", "level").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("spread"))
    return g.withColumn("off", F.col("spread") > 2)


@operator("A17 Q22", """SELECT page_id, entries, links, bookmarks, entries = links AND links = bookmarks AS equal FROM (SELECT p.page_id, coalesce(t.n, 0) AS entries, len(regexp_extract_all(html, '<a [^>]*href=')) AS links, len(regexp_extract_all(html, '<(h[1-6]|li)[ >]')) AS bookmarks FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM te WHERE title <> '' GROUP BY page_id) t ON t.page_id = p.page_id)""")
def contents_counts(v):
    """Entries, links and bookmarks of a contents page must be equally many."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    p = v.pages.select("page_id", n("<a [^>]*href=").alias("links"), n("<(h[1-6]|li)[ >]").alias("bookmarks"))
    t = v.te.where("title <> ''").groupBy("page_id").agg(F.count(F.lit(1)).alias("entries"))
    out = p.join(t, "page_id", "left").fillna(0, ["entries"])
    return out.withColumn("equal", (F.col("entries") == F.col("links")) & (F.col("links") == F.col("bookmarks"))).select("page_id", "entries", "links", "bookmarks", "equal")


@operator("R2", "SELECT page_id, max(links) AS links, max(titles) AS titles, max(links) = max(titles) AS equal FROM (SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=')) AS links, 0 AS titles FROM pages UNION ALL SELECT page_id, 0, count(*) FROM toc WHERE title <> '' GROUP BY page_id) GROUP BY page_id")
def toc_count(v):
    """Links of a page against its titled entries."""
    links = v.pages.select("page_id", F.regexp_count("html", F.lit("<a [^>]*href=")).cast("long").alias("links"))
    titles = v.toc.where("title <> ''").groupBy("page_id").agg(F.count(F.lit(1)).alias("titles"))
    return links.join(titles, "page_id", "left").select("page_id", "links", F.coalesce("titles", F.lit(0)).alias("titles")).withColumn("equal", F.col("links") == F.col("titles"))



@operator("A19 L1 L2", """SELECT page_key, CAST(min(fit) AS DOUBLE) AS size FROM (SELECT page_key, coalesce(list_filter(list_transform(range(0, 25), lambda i: 10 - 0.25 * i), lambda s: length(txt) * s * 0.55 <= 1.5 * (x1 - x0))[1], 4.0) AS fit FROM rc) GROUP BY page_key""")
def table_font_size(v):
    """One size for a table: the smallest of the largest sizes (in steps of a quarter) that fit its cells."""
    sizes = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: 10 - 0.25 * i)
    fit = F.coalesce(F.get(F.filter(sizes, lambda s: F.length("txt") * s * 0.55 <= 1.5 * (F.col("x1") - F.col("x0"))), F.lit(0)), F.lit(4.0))
    return v.rc.groupBy("page_key").agg(F.min(fit).alias("size"))



@operator("A22 A25", "SELECT page_key, island, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(length(txt)) AS widest FROM (SELECT *, rid - row_number() OVER (PARTITION BY page_key, size ORDER BY rid) AS island FROM rc) GROUP BY page_key, size, island")
def run_boxes(v):
    """Bounding boxes of runs of neighbours of one size."""
    r = v.rc.withColumn("island", F.col("rid") - F.row_number().over(Window.partitionBy("page_key", "size").orderBy("rid")))
    return r.groupBy("page_key", "size", "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max(F.length("txt")).cast("long").alias("widest")).drop("size")


@operator("A24 A28", "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type")
def usage_totals(v):
    """Calls, totals and means by kind."""
    return v.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 50).alias("high"))




@operator("A30", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.9) AS p90, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def interpolated_quantiles(v):
    """Interpolating medians and percentiles."""
    return v.lineitem.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.5).alias("med"), F.percentile("l_extendedprice", 0.9).alias("p90"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))
