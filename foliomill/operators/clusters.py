"""Clustering, gaps and islands, folds and fixpoints. Every fold runs over a total order that ends in the row's id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.plans.registry import operator


@operator("C1 S11", "SELECT page_key, row_no, count(*) AS n, min(y1) AS top FROM (SELECT *, sum(new) OVER (PARTITION BY page_key ORDER BY y1, rid) AS row_no FROM (SELECT *, CASE WHEN y1 - lag(y1) OVER (PARTITION BY page_key ORDER BY y1, rid) > 3 THEN 1 ELSE 0 END AS new FROM rc)) GROUP BY page_key, row_no", big="row_no")
def baseline_rows(v):
    """Rows by baseline: a new one where the baseline is over 3 points from the one before."""
    w = Window.partitionBy("page_key").orderBy("y1", "rid")
    r = v.rc.withColumn("new", F.when(F.col("y1") - F.lag("y1").over(w) > 3, 1).otherwise(0)).withColumn("row_no", F.sum("new").over(w))
    return r.groupBy("page_key", "row_no").agg(F.count(F.lit(1)).alias("n"), F.min("y1").alias("top"))


@operator("C2 C5 V7", "SELECT page_key, axis, k, min(a) AS a, max(b) AS b, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY page_key, axis, k ORDER BY a, b) AS isle FROM (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY page_key, axis, k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.5 THEN 1 ELSE 0 END AS new FROM sg)) GROUP BY page_key, axis, k, isle", big="k")
def segment_coalesce(v):
    """Collinear segments joined where one starts within 1.5 points of the furthest end so far."""
    w = Window.partitionBy("page_key", "axis", "k").orderBy("a", "b")
    far = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = v.sg.withColumn("new", F.when(F.col("a") > far + 1.5, 1).otherwise(0)).withColumn("isle", F.sum("new").over(w))
    return s.groupBy("page_key", "axis", "k", "isle").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n")).drop("isle")


@operator("C3 R4", """SELECT page_key, CAST(len(list_reduce(ks, lambda a, x: CASE WHEN len(a) = 0 OR x - a[-1] > 2 THEN list_append(a, x) ELSE a END, CAST([] AS BIGINT[]))) AS BIGINT) AS anchors, list_reduce(ks, lambda a, x: CASE WHEN len(a) = 0 OR x - a[-1] > 2 THEN list_append(a, x) ELSE a END, CAST([] AS BIGINT[])) AS kept FROM (SELECT page_key, list(k ORDER BY k) AS ks FROM (SELECT DISTINCT page_key, CAST(k AS BIGINT) AS k FROM sg WHERE axis = 'H') GROUP BY page_key)""")
def anchor_cluster(v):
    """Values within 2 of their cluster's first member: chains don't extend a cluster."""
    s = v.sg.where("axis = 'H'").groupBy("page_key").agg(F.array_sort(F.collect_set(F.col("k").cast("long"))).alias("ks"))
    fold = F.aggregate("ks", F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) > 2), F.array_append(a, x)).otherwise(a))
    return s.select("page_key", fold.alias("kept")).select("page_key", F.size("kept").alias("anchors"), "kept")


@operator("X6 J25", """WITH RECURSIVE caught AS (SELECT page_key, rid FROM rc WHERE size = 10 UNION SELECT b.page_key, b.rid FROM caught c JOIN rc a ON a.page_key = c.page_key AND a.rid = c.rid JOIN rc b ON b.page_key = a.page_key AND b.y0 - a.y1 BETWEEN -4 AND 6 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.4 * (b.x1 - b.x0)) SELECT page_key, rid FROM caught""")
def caption_contagion(v):
    """Blocks right below a caption that overlap it by 40 % are caption too, and so on."""
    b = v.rc.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct(F.col("rid").alias("i"), "x0", "y0", "x1", "y1", (F.col("size") == 10).alias("l")))).alias("bs"))
    follows = lambda a, c: c["l"] & (a["y0"] - c["y1"]).between(-4, 6) & (F.least(c["x1"], a["x1"]) - F.greatest(c["x0"], a["x0"]) > 0.4 * (a["x1"] - a["x0"]))
    spread = lambda arr: F.transform(arr, lambda a: F.struct(a["i"].alias("i"), a["x0"].alias("x0"), a["y0"].alias("y0"), a["x1"].alias("x1"), a["y1"].alias("y1"), (a["l"] | F.exists(arr, lambda c: follows(a, c))).alias("l")))
    done = F.aggregate(F.sequence(F.lit(1), F.size("bs")), F.col("bs"), lambda acc, _: spread(acc))
    return b.select("page_key", F.explode(F.filter(done, lambda a: a["l"])).alias("e")).select("page_key", F.col("e.i").alias("rid"))

