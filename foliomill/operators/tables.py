"""Tables from ruled segments: frames, bands, grids, cells and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.plans.registry import operator




@operator("X3 D8 J9", """SELECT page_key, r, c, string_agg(txt, ' ' ORDER BY y0, x0, rid) AS cell, count(*) AS words FROM (SELECT *, CAST(floor(y0 / 50) AS BIGINT) AS r, CAST(floor(x0 / 100) AS BIGINT) AS c FROM rc) GROUP BY page_key, r, c""")
def grid_cells(v):
    """The words of each cell of a 3 by 4 grid in reading order."""
    g = v.rc.withColumn("r", F.floor(F.col("y0") / 50)).withColumn("c", F.floor(F.col("x0") / 100)).groupBy("page_key", "r", "c").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "rid", "txt"))).alias("ws"))
    return g.select("page_key", "r", "c", F.array_join(F.col("ws.txt"), " ").alias("cell"), F.size("ws").alias("words"))


@operator("J12 X1", """SELECT page_key, c, min(r) AS r0, max(r) AS r1 FROM (SELECT page_key, c, r, r - row_number() OVER (PARTITION BY page_key, c ORDER BY r) AS g FROM (SELECT DISTINCT page_key, CAST(floor(x0 / 100) AS BIGINT) AS c, CAST(floor(y0 / 20) AS BIGINT) AS r FROM rc WHERE l_linenumber % 2 = 0)) GROUP BY page_key, c, g""")
def vertical_spans(v):
    """Runs of merged cells by column: first and last row."""
    d = v.rc.where("l_linenumber % 2 = 0").select("page_key", F.floor(F.col("x0") / 100).alias("c"), F.floor(F.col("y0") / 20).alias("r")).distinct()
    g = d.withColumn("g", F.col("r") - F.row_number().over(Window.partitionBy("page_key", "c").orderBy("r")))
    return g.groupBy("page_key", "c", "g").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).drop("g")


@operator("C6", """SELECT page_key, count(*) AS bridged FROM (SELECT DISTINCT h.page_key, h.k, h.a, h.b FROM sg h JOIN sg g ON g.page_key = h.page_key AND g.axis = 'H' AND h.axis = 'H' AND g.k > h.k AND least(h.b, g.b) - greatest(h.a, g.a) > 0.55 * greatest(h.b - h.a, g.b - g.a) JOIN sg v ON v.page_key = h.page_key AND v.axis = 'V' AND v.k BETWEEN h.a AND h.b AND v.k BETWEEN g.a AND g.b) GROUP BY page_key""")
def bridged_rules(v):
    """Rules with a lower one that covers 55 % of the wider of both, and a vertical rule across the two."""
    h = v.sg.where("axis = 'H'").select("page_key", "k", "a", "b")
    g = h.select(F.col("page_key").alias("gp"), F.col("k").alias("gk"), F.col("a").alias("ga"), F.col("b").alias("gb"))
    u = v.sg.where("axis = 'V'").select(F.col("page_key").alias("vp"), F.col("k").alias("vk")).distinct()
    two = h.join(g, (F.col("page_key") == F.col("gp")) & (F.col("gk") > F.col("k")) & (F.least("b", "gb") - F.greatest("a", "ga") > 0.55 * F.greatest(F.col("b") - F.col("a"), F.col("gb") - F.col("ga"))))
    on = two.join(u, (F.col("page_key") == F.col("vp")) & F.col("vk").between(F.greatest("a", "ga"), F.least("b", "gb")), "left_semi")
    return on.select("page_key", "k", "a", "b").distinct().groupBy("page_key").agg(F.count(F.lit(1)).alias("bridged"))


@operator("L4", """SELECT page_key, rid, CASE WHEN length(txt) * size * 0.55 <= x1 - x0 THEN size ELSE greatest(4, floor((x1 - x0) / (0.55 * length(txt)) * 4) / 4) END AS fit, CAST(ceil(length(txt) * size * 0.55 / (x1 - x0)) AS BIGINT) AS lines FROM rc""")
def cell_plan(v):
    """The size at which a cell's text fits on one line (quarter steps, at least 4) and its lines at full size."""
    n, w = F.length("txt"), F.col("x1") - F.col("x0")
    fit = F.when(n * F.col("size") * 0.55 <= w, F.col("size").cast("double")).otherwise(F.greatest(F.lit(4.0), F.floor(w / (n * 0.55) * 4) / 4))
    return v.rc.select("page_key", "rid", fit.alias("fit"), F.ceil(n * F.col("size") * 0.55 / w).alias("lines"))
