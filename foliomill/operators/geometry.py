"""Geometry algebra and layout arithmetic on rectangles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.functions import geometry as g
from foliomill.plans.registry import operator


def pairs(v, extra=()):
    a = v.rc.select("page_key", F.col("rid").alias("a_rid"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1", *extra)])
    b = v.rc.select("page_key", F.col("rid").alias("b_rid"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1", *extra)])
    return a.join(b, "page_key").where("a_rid < b_rid")


AREA_A, AREA_B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
SHARED = "(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"
GAP = "greatest(b.x0 - a.x1, a.x0 - b.x1, b.y0 - a.y1, a.y0 - b.y1, 0)"


@operator("G1 G2 G4 D5", f"""SELECT a.page_key, a.rid AS a_rid, b.rid AS b_rid, {SHARED} AS shared, {SHARED} / {AREA_A} AS of_self, {SHARED} / least({AREA_A}, {AREA_B}) AS of_smaller, {SHARED} / greatest({AREA_A}, {AREA_B}) AS of_larger, {GAP} AS gap, least(a.x0, b.x0) AS ux0, greatest(a.y1, b.y1) AS uy1, a.x0 - 2 AS grown_x0, a.y1 + 2 AS grown_y1, (a.x0 + a.x1) / 2 AS cx, (a.y0 + a.y1) / 2 AS cy, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS beside FROM rc a JOIN rc b ON a.page_key = b.page_key AND a.rid < b.rid WHERE {GAP} <= 4""")
def overlap_ratios(v):
    """Neighbouring pairs with their overlap by each denominator, gap, union, centre, the first one grown, and their overlap in height."""
    p = pairs(v).withColumn("shared", g.shared("a_", "b_")).withColumn("gap", g.gap("a_", "b_")).where("gap <= 4")
    r = lambda d: F.col("shared") / d
    return p.select("page_key", "a_rid", "b_rid", "shared", r(g.area("a_")).alias("of_self"), r(F.least(g.area("a_"), g.area("b_"))).alias("of_smaller"), r(F.greatest(g.area("a_"), g.area("b_"))).alias("of_larger"), "gap", F.least("a_x0", "b_x0").alias("ux0"), F.greatest("a_y1", "b_y1").alias("uy1"), (F.col("a_x0") - 2).alias("grown_x0"), (F.col("a_y1") + 2).alias("grown_y1"), ((F.col("a_x0") + F.col("a_x1")) / 2).alias("cx"), ((F.col("a_y0") + F.col("a_y1")) / 2).alias("cy"), (F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")).alias("beside"))




@operator("N5 V9 D19", "SELECT geo_id, deg, round(30 * 20 / sqrt(power(20 * cos(radians(deg)), 2) + power(30 * sin(radians(deg)), 2)), 6) AS radius FROM ring", big="deg")
def ellipse_radius(v):
    """The radius of a 30 by 20 ellipse at each sampled angle."""
    t = F.radians("deg")
    return v.ring.select("geo_id", "deg", F.round(600 / F.sqrt(F.pow(20 * F.cos(t), 2.0) + F.pow(30 * F.sin(t), 2.0)), 6).alias("radius"))


@operator("Q40", """SELECT geo_id, max(n) AS longest, count(*) AS arcs FROM (SELECT geo_id, g, count(*) AS n FROM (SELECT geo_id, deg, k, k - row_number() OVER (PARTITION BY geo_id ORDER BY k) AS g FROM (SELECT geo_id, deg, deg // 5 AS k, v FROM ring UNION ALL SELECT geo_id, deg, deg // 5 + 72, v FROM ring) WHERE v < 60) GROUP BY geo_id, g) WHERE n >= 3 GROUP BY geo_id""")
def ring_residue(v):
    """Rings with arcs of at least three dark samples; samples wrap around, so each ring is read twice in a row."""
    k = (F.col("deg") / 5).cast("int")
    twice = v.ring.where("v < 60").select("geo_id", F.explode(F.array(k, k + 72)).alias("k"))
    isle = twice.withColumn("g", F.col("k") - F.row_number().over(Window.partitionBy("geo_id").orderBy("k"))).groupBy("geo_id", "g").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return isle.groupBy("geo_id").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("arcs"))


@operator("V13 V7", "SELECT xref, place_no, CAST(round(width_pt * 150 / 72, 0) AS BIGINT) AS px, page % 7 * 150 / 72.0 AS x_px FROM img")
def overlay_pixels(v):
    """Placements in pixels at 150 dpi."""
    return v.img.select("xref", "place_no", F.round(F.col("width_pt") * 150 / 72, 0).cast("long").alias("px"), (F.col("page") % 7 * 150 / F.lit(72.0)).alias("x_px"))


@operator("L10", "SELECT page_key, count(*) AS n, CASE WHEN count(*) % 5 IN (1, 2) AND count(*) > 5 THEN count(*) % 5 + 3 ELSE count(*) % 5 END AS tail FROM rc GROUP BY page_key")
def widow_control(v):
    """Rows on the last sheet of five: a tail of one or two takes three more along."""
    c = v.rc.groupBy("page_key").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("tail", F.when((F.col("n") % 5).isin(1, 2) & (F.col("n") > 5), F.col("n") % 5 + 3).otherwise(F.col("n") % 5))
