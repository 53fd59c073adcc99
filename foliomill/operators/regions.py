"""Regions on dense pages: groups that touch, geometric dedupe, labels, figures, table families and column edges.

A page's boxes are folded in one pass over an array with a total order; pages are the unit that is dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.plans.registry import VIEW_SQL, operator

BOX = ("x0", "y0", "x1", "y1")
MEET = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"

#: Some dozens of boxes a page, of all sizes, over a Letter page.
VIEW_SQL["bx"] = """SELECT page_key, rid, x0, y0, x0 + 10 + 2 * q AS x1, y0 + 8 + n % 5 AS y1, 6 + n % 5 AS size, txt, n FROM (SELECT l_orderkey // 16 AS page_key, row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rid, CAST(l_partkey * 7 % 540 AS DOUBLE) AS x0, CAST((l_suppkey * 31 + l_linenumber * 97 + l_orderkey * 13) % 740 AS DOUBLE) AS y0, l_quantity AS q, l_linenumber AS n, p_name AS txt FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def boxes(v):
    key = F.floor(F.col("l_orderkey") / 16)
    rid = F.row_number().over(Window.partitionBy(key).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = v.lineitem.join(v.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("txt")), "l_partkey")
    r = li.select(key.alias("page_key"), rid.cast("long").alias("rid"), (F.col("l_partkey") * 7 % 540).cast("double").alias("x0"), ((F.col("l_suppkey") * 31 + F.col("l_linenumber") * 97 + F.col("l_orderkey") * 13) % 740).cast("double").alias("y0"), "l_quantity", F.col("l_linenumber").cast("long").alias("n"), "txt")
    return r.select("page_key", "rid", "x0", "y0", (F.col("x0") + 10 + 2 * F.col("l_quantity")).alias("x1"), (F.col("y0") + 8 + F.col("n") % 5).alias("y1"), (6 + F.col("n") % 5).alias("size"), "txt", "n")


def meet(a, b):
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def touching_groups(column):
    """An array of boxes (structs with x0, y0, x1, y1) as an array of groups that are connected by boxes that meet.

    Each box joins all groups that it meets into one, so a single pass finds chains of any length.
    """

    def step(groups, x):
        meets = lambda g: F.exists(g["m"], lambda b: meet(b, x))
        joined = F.flatten(F.transform(F.filter(groups, meets), lambda g: g["m"]))
        return F.array_append(F.filter(groups, lambda g: ~meets(g)), F.struct(F.array_append(joined, x).alias("m")))

    start = F.filter(F.transform(column, lambda x: F.struct(F.array(x).alias("m"))), lambda g: F.lit(False))
    return F.aggregate(column, start, step)


def page_boxes(df, *more):
    return df.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("rid", *BOX, *more))).alias("bs"))


@operator("U1 C9", f"""WITH RECURSIVE reach AS (SELECT page_key, rid, rid AS other FROM bx UNION SELECT r.page_key, r.rid, b.rid FROM reach r JOIN bx a ON a.page_key = r.page_key AND a.rid = r.other JOIN bx b ON b.page_key = a.page_key AND {MEET})
  SELECT page_key, region, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT page_key, rid, min(other) AS region FROM reach GROUP BY page_key, rid) JOIN bx USING (page_key, rid) GROUP BY page_key, region""")
def touching_regions(v):
    """Rectangles of a page joined while they touch one another, to any depth, with the box around each group."""
    g = page_boxes(boxes(v)).select("page_key", F.explode(touching_groups(F.col("bs"))).alias("g")).select("page_key", "g.m")
    side = lambda f, c: f(F.transform("m", lambda b: b[c])).alias(c)
    return g.select("page_key", F.array_min(F.transform("m", lambda b: b["rid"])).alias("region"), F.size("m").cast("long").alias("n"), side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))


DEDUPE = """(i >= 0.35 * greatest((k.x1 - k.x0) * (k.y1 - k.y0), (u.x1 - u.x0) * (u.y1 - u.y0))) OR (i > 0 AND (k.txt = u.txt OR (length(u.txt) >= 3 AND contains(k.txt, u.txt)))) OR (k.txt = u.txt AND abs((k.y0 + k.y1) / 2 - (u.y0 + u.y1) / 2) < 12 AND abs(k.x0 - u.x0) < 24)"""
INTER = "(greatest(least(k.x1, u.x1) - greatest(k.x0, u.x0), 0) * greatest(least(k.y1, u.y1) - greatest(k.y0, u.y0), 0))"
_DUCK_SAME = DEDUPE.replace("(i ", f"({INTER} ").replace("u.", "u[1].").replace(INTER, INTER.replace("u.", "u[1]."))


@operator("X7", f"""SELECT page_key, r.rid, r.x0, r.y0, r.x1, r.y1 FROM (SELECT page_key, unnest(list_reduce(us, lambda acc, u: CASE WHEN len(list_filter(acc, lambda k: {_DUCK_SAME})) = 0 THEN list_append(acc, u[1]) ELSE list_transform(acc, lambda k, j: CASE WHEN j = list_position(list_transform(acc, lambda k: {_DUCK_SAME}), true) THEN {{'rid': k.rid, 'txt': k.txt, 'x0': least(k.x0, u[1].x0), 'y0': least(k.y0, u[1].y0), 'x1': greatest(k.x1, u[1].x1), 'y1': greatest(k.y1, u[1].y1)}} ELSE k END) END)) AS r
  FROM (SELECT page_key, list([{{'rid': rid, 'txt': txt, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] ORDER BY length(txt) DESC, rid) AS us FROM bx GROUP BY page_key))""")
def geometric_dedupe(v):
    """The longest text first; a later unit goes into the first keeper that covers it, shares its text or repeats it nearby, which grows.

    Cover is 35 % of the larger area; a shared text is an equal one, or a part of three characters or more, where both meet; a repeat is
    an equal text within 12 points down and 24 across.
    """
    us = boxes(v).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct((-F.length("txt")).alias("o"), "rid", "txt", *BOX))).alias("us"))
    empty = F.array().cast("array<struct<rid:bigint,txt:string,x0:double,y0:double,x1:double,y1:double>>")

    def same(k, u):
        side = lambda lo, hi: F.greatest(F.least(k[hi], u[hi]) - F.greatest(k[lo], u[lo]), F.lit(0.0))
        inter = side("x0", "x1") * side("y0", "y1")
        area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
        part = (F.length(u["txt"]) >= 3) & F.contains(k["txt"], u["txt"])
        again = (F.abs((k["y0"] + k["y1"]) / 2 - (u["y0"] + u["y1"]) / 2) < 12) & (F.abs(k["x0"] - u["x0"]) < 24)
        return (inter >= 0.35 * F.greatest(area(k), area(u))) | ((inter > 0) & ((k["txt"] == u["txt"]) | part)) | ((k["txt"] == u["txt"]) & again)

    def step(acc, u):
        at = F.array_position(F.transform(acc, lambda k: same(k, u)), F.lit(True))
        grown = lambda k: F.struct(k["rid"].alias("rid"), k["txt"].alias("txt"), F.least(k["x0"], u["x0"]).alias("x0"), F.least(k["y0"], u["y0"]).alias("y0"), F.greatest(k["x1"], u["x1"]).alias("x1"), F.greatest(k["y1"], u["y1"]).alias("y1"))
        own = F.struct(u["rid"].alias("rid"), u["txt"].alias("txt"), *[u[c].alias(c) for c in BOX])
        return F.when(at == 0, F.array_append(acc, own)).otherwise(F.transform(acc, lambda k, j: F.when(j + 1 == at, grown(k)).otherwise(k)))

    return us.select("page_key", F.explode(F.aggregate("us", empty, step)).alias("r")).select("page_key", "r.rid", *[f"r.{c}" for c in BOX])


# ---------------------------------------------------------------- labels and figures

NEAR = "l.x1 >= c.x0 - 60 AND l.x0 <= c.x1 + 60 AND l.y1 >= c.y0 - 24 AND l.y0 <= c.y1 + 24"
GAP = "greatest(c.x0 - l.x1, l.x0 - c.x1, c.y0 - l.y1, l.y0 - c.y1, 0)"


def _round_sql(k: int) -> str:
    labels = "SELECT page_key, rid, x0, y0, x1, y1 FROM bx WHERE size = 6" + "".join(f" AND (page_key, rid) NOT IN (SELECT (page_key, rid) FROM own{j})" for j in range(1, k))
    return f"""own{k} AS (SELECT l.page_key, l.rid, arg_min(c.rid, {{'g': {GAP}, 'r': c.rid}}) AS cluster, any_value(l.x0) AS x0, any_value(l.y0) AS y0, any_value(l.x1) AS x1, any_value(l.y1) AS y1 FROM ({labels}) l JOIN cl{k - 1} c ON c.page_key = l.page_key AND {NEAR} GROUP BY l.page_key, l.rid),
  cl{k} AS (SELECT c.page_key, c.rid, least(any_value(c.x0), coalesce(min(o.x0), any_value(c.x0))) AS x0, least(any_value(c.y0), coalesce(min(o.y0), any_value(c.y0))) AS y0, greatest(any_value(c.x1), coalesce(max(o.x1), any_value(c.x1))) AS x1, greatest(any_value(c.y1), coalesce(max(o.y1), any_value(c.y1))) AS y1 FROM cl{k - 1} c LEFT JOIN own{k} o ON o.page_key = c.page_key AND o.cluster = c.rid GROUP BY c.page_key, c.rid)"""


@operator("C10 J24", "WITH cl0 AS (SELECT page_key, rid, x0, y0, x1, y1 FROM bx WHERE size >= 10), " + ", ".join(_round_sql(k) for k in (1, 2, 3)) + " SELECT page_key, rid, cluster, round FROM (" + " UNION ALL ".join(f"SELECT page_key, rid, cluster, {k} AS round FROM own{k}" for k in (1, 2, 3)) + ")", big="round")
def adsorbed_labels(v):
    """Small labels taken in by the nearest cluster within 60 points sideways and 24 up or down, in three rounds.

    A cluster grows by what it took in before the next round; a label that has an owner keeps it.
    """
    r = boxes(v)
    free = r.where("size = 6").select("page_key", "rid", *BOX)
    clusters = r.where("size >= 10").select(F.col("page_key").alias("cp"), F.col("rid").alias("cluster"), *[F.col(c).alias(f"c{c}") for c in BOX])
    near = F.expr("page_key = cp AND x1 >= cx0 - 60 AND x0 <= cx1 + 60 AND y1 >= cy0 - 24 AND y0 <= cy1 + 24")
    gap = F.expr("greatest(cx0 - x1, x0 - cx1, cy0 - y1, y0 - cy1, 0D)")
    out = None
    for k in (1, 2, 3):
        own = free.join(clusters, near).groupBy("page_key", "rid", *BOX).agg(F.min_by("cluster", F.struct(gap, "cluster")).alias("cluster"))
        part = own.select("page_key", "rid", "cluster", F.lit(k).alias("round"))
        out = part if out is None else out.unionByName(part)
        if k < 3:
            free = free.join(own.select("page_key", "rid"), ["page_key", "rid"], "left_anti")
            taken = own.groupBy(F.col("page_key").alias("tp"), F.col("cluster").alias("tc")).agg(F.min("x0").alias("tx0"), F.min("y0").alias("ty0"), F.max("x1").alias("tx1"), F.max("y1").alias("ty1"))
            j = clusters.join(taken, F.expr("cp = tp AND cluster = tc"), "left")
            clusters = j.select("cp", "cluster", F.least("cx0", "tx0").alias("cx0"), F.least("cy0", "ty0").alias("cy0"), F.greatest("cx1", "tx1").alias("cx1"), F.greatest("cy1", "ty1").alias("cy1"))
    return out


@operator("C9 S4 F9", """SELECT page_key, c, n, x0, y0, x1, y1, labels FROM (SELECT page_key, c, count(*) FILTER (WHERE size > 6) AS n, count(*) FILTER (WHERE size = 6) AS labels, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT *, sum(new) OVER (PARTITION BY page_key ORDER BY y0, rid) AS c FROM (SELECT *, CASE WHEN mx IS NULL THEN 0 WHEN y0 > mx + 26 OR EXISTS (SELECT 1 FROM bx t WHERE t.page_key = a.page_key AND t.size = 7 AND t.y0 >= mx AND t.y1 <= a.y0) THEN 1 ELSE 0 END AS new
  FROM (SELECT *, max(y1) OVER (PARTITION BY page_key ORDER BY y0, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM bx WHERE size <> 7) a)) GROUP BY page_key, c) WHERE n >= 2 AND x1 - x0 >= 40 AND y1 - y0 >= 12""", big="c")
def figure_scan(v):
    """Figures: art clustered down the page while gaps are at most 26 points and no line of text lies in the gap; small ones are left out."""
    r = boxes(v)
    o = Window.partitionBy("page_key").orderBy("y0", "rid")
    a = r.where("size <> 7").withColumn("mx", F.max("y1").over(o.rowsBetween(Window.unboundedPreceding, -1)))
    t = r.where("size = 7").select(F.col("page_key").alias("tp"), F.col("y0").alias("ty0"), F.col("y1").alias("ty1"))
    blocked = a.where("y0 <= mx + 26 AND y0 >= mx").join(t, F.expr("page_key = tp AND ty0 >= mx AND ty1 <= y0"), "left_semi").select("page_key", "rid", F.lit(True).alias("blocked"))
    new = F.expr("CASE WHEN mx IS NULL THEN 0 WHEN y0 > mx + 26 OR coalesce(blocked, false) THEN 1 ELSE 0 END")
    c = a.join(blocked, ["page_key", "rid"], "left").withColumn("new", new).withColumn("c", F.sum("new").over(o))
    g = c.groupBy("page_key", "c").agg(F.count_if(F.col("size") > 6).alias("n"), F.count_if(F.col("size") == 6).alias("labels"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.where("n >= 2 AND x1 - x0 >= 40 AND y1 - y0 >= 12")


@operator("X9 G6", """SELECT page_key, rid, CASE WHEN area > 4 * own THEN 'fallback' ELSE 'ok' END AS verdict, CASE WHEN area > 4 * own THEN x0 ELSE e0 END AS x0, CASE WHEN area > 4 * own THEN y0 ELSE f0 END AS y0, CASE WHEN area > 4 * own THEN x1 ELSE e1 END AS x1, CASE WHEN area > 4 * own THEN y1 ELSE f1 END AS y1 FROM (SELECT *, (e1 - e0) * (f1 - f0) AS area, (x1 - x0) * (y1 - y0) AS own FROM (SELECT f.page_key, f.rid, any_value(f.x0) AS x0, any_value(f.y0) AS y0, any_value(f.x1) AS x1, any_value(f.y1) AS y1,
  least(any_value(f.x0), coalesce(min(l.x0), 1e9)) AS e0, least(any_value(f.y0), coalesce(min(l.y0), 1e9)) AS f0, greatest(any_value(f.x1), coalesce(max(l.x1), -1e9)) AS e1, greatest(any_value(f.y1), coalesce(max(l.y1), -1e9)) AS f1 FROM (SELECT * FROM bx WHERE size >= 9) f LEFT JOIN (SELECT * FROM bx WHERE size = 6) l ON l.page_key = f.page_key AND l.x0 < f.x1 + 3 AND l.x1 > f.x0 - 3 AND l.y0 < f.y1 + 3 AND l.y1 > f.y0 - 3 GROUP BY f.page_key, f.rid))""")
def safe_extent(v):
    """A figure's box grown over the labels it cuts; beyond four times its own area the plain box stands, with a warning."""
    r = boxes(v)
    f = r.where("size >= 9").select("page_key", "rid", *BOX)
    lab = r.where("size = 6").select(F.col("page_key").alias("lp"), *[F.col(c).alias(f"l{c}") for c in BOX])
    j = f.join(lab, F.expr("page_key = lp AND lx0 < x1 + 3 AND lx1 > x0 - 3 AND ly0 < y1 + 3 AND ly1 > y0 - 3"), "left").groupBy("page_key", "rid", *BOX).agg(F.min("lx0").alias("a0"), F.min("ly0").alias("b0"), F.max("lx1").alias("a1"), F.max("ly1").alias("b1"))
    e = j.select("page_key", "rid", *BOX, F.least("x0", "a0").alias("e0"), F.least("y0", "b0").alias("f0"), F.greatest("x1", "a1").alias("e1"), F.greatest("y1", "b1").alias("f1"))
    far = F.expr("(e1 - e0) * (f1 - f0) > 4 * ((x1 - x0) * (y1 - y0))")
    return e.select("page_key", "rid", F.when(far, "fallback").otherwise("ok").alias("verdict"), *[F.when(far, F.col(c)).otherwise(F.col(g)).alias(c) for c, g in zip(BOX, ("e0", "f0", "e1", "f1"))])


def _clear_sql() -> str:
    step = "CASE WHEN list_extract(t, 1).y1 > a.lo AND list_extract(t, 1).y0 < a.hi THEN CASE WHEN (list_extract(t, 1).y0 + list_extract(t, 1).y1) / 2 < (a.lo + a.hi) / 2 THEN {'lo': CASE WHEN least(list_extract(t, 1).y1 + 0.5, a.hi) > a.lo THEN least(list_extract(t, 1).y1 + 0.5, a.hi) ELSE a.lo END, 'hi': a.hi} ELSE {'lo': a.lo, 'hi': CASE WHEN greatest(list_extract(t, 1).y0 - 0.5, a.lo) < a.hi THEN greatest(list_extract(t, 1).y0 - 0.5, a.lo) ELSE a.hi END} END ELSE a END"
    return step.replace("list_extract(t, 1)", "t")


@operator("G7", f"""SELECT page_key, rid, c.lo AS y0, c.hi AS y1, c.hi - c.lo < 0.55 * (y1 - y0) AS warned FROM (SELECT page_key, rid, y0, y1, list_reduce(list_concat([{{'y0': y0, 'y1': y1, 'lo': y0, 'hi': y1}}], flatten([ts, ts, ts, ts])), lambda a, t: {{'y0': a.y0, 'y1': a.y1, 'lo': ({_clear_sql()}).lo, 'hi': ({_clear_sql()}).hi}}) AS c
  FROM (SELECT f.page_key, f.rid, f.y0 - 20 AS y0, f.y1 + 20 AS y1, list({{'y0': t.y0, 'y1': t.y1, 'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}} ORDER BY t.y0, t.rid) AS ts FROM bx f JOIN bx t ON t.page_key = f.page_key AND t.size = 7 AND t.y0 < f.y1 + 20 AND t.y1 > f.y0 - 20 AND t.x0 < f.x1 AND t.x1 > f.x0 WHERE f.size = 10 GROUP BY ALL))""".replace("{'lo'", "{'lo'"))
def clip_clearance(v):
    """Clips drawn in, up or down on the side a text lies nearer to, until no text is left in them: four rounds over the texts in order.

    A clip that keeps under 55 % of its height is warned of.
    """
    r = boxes(v)
    f = r.where("size = 10").select("page_key", "rid", "x0", "x1", (F.col("y0") - 20).alias("y0"), (F.col("y1") + 20).alias("y1"))
    t = r.where("size = 7").select(F.col("page_key").alias("tp"), F.col("rid").alias("trid"), *[F.col(c).alias(f"t{c}") for c in BOX])
    g = f.join(t, F.expr("page_key = tp AND ty0 < y1 AND ty1 > y0 AND tx0 < x1 AND tx1 > x0")).groupBy("page_key", "rid", "y0", "y1").agg(F.array_sort(F.collect_list(F.struct("ty0", "trid", "ty1"))).alias("ts"))

    def step(a, t):
        left = (t["ty1"] > a["lo"]) & (t["ty0"] < a["hi"])
        upper = (t["ty0"] + t["ty1"]) / 2 < (a["lo"] + a["hi"]) / 2
        down, up = F.least(t["ty1"] + 0.5, a["hi"]), F.greatest(t["ty0"] - 0.5, a["lo"])
        return F.struct(F.when(left & upper & (down > a["lo"]), down).otherwise(a["lo"]).alias("lo"), F.when(left & ~upper & (up < a["hi"]), up).otherwise(a["hi"]).alias("hi"))

    c = F.aggregate(F.flatten(F.array_repeat("ts", 4)), F.struct(F.col("y0").alias("lo"), F.col("y1").alias("hi")), step)
    return g.select("page_key", "rid", "y0", "y1", c.alias("c")).select("page_key", "rid", F.col("c.lo").alias("y0"), F.col("c.hi").alias("y1"), (F.col("c.hi") - F.col("c.lo") < 0.55 * (F.col("y1") - F.col("y0"))).alias("warned"))


# ---------------------------------------------------------------- table families and columns

#: Rules of tables: page, position, extent.
VIEW_SQL["hr"] = "SELECT DISTINCT page_key, CAST(y1 AS DOUBLE) AS y, x0 AS a, x1 AS b FROM bx WHERE size >= 8"


def rules(v):
    return boxes(v).where("size >= 8").select("page_key", F.col("y1").alias("y"), F.col("x0").alias("a"), F.col("x1").alias("b")).distinct()


FAMILY = "least(f.b, h[1].b) - greatest(f.a, h[1].a) > 0.55 * greatest(f.b - f.a, h[1].b - h[1].a) AND h[1].last - f.last <= 80"


@operator("C6", f"""SELECT page_key, f.a, f.b, f.top, f.last AS bottom, f.n FROM (SELECT page_key, unnest(list_reduce(hs, lambda acc, h: CASE WHEN len(list_filter(acc, lambda f: {FAMILY})) = 0 THEN list_append(acc, h[1]) ELSE list_transform(acc, lambda f, j: CASE WHEN j = list_position(list_transform(acc, lambda f: {FAMILY}), true) THEN {{'a': least(f.a, h[1].a), 'b': greatest(f.b, h[1].b), 'top': f.top, 'last': h[1].last, 'n': f.n + 1}} ELSE f END) END)) AS f
  FROM (SELECT page_key, list([{{'a': a, 'b': b, 'top': y, 'last': y, 'n': CAST(1 AS BIGINT)}}] ORDER BY y, a, b) AS hs FROM hr GROUP BY page_key)) WHERE f.n >= 3""")
def rule_families(v):
    """Families of horizontal rules: each goes to the first family it overlaps by 55 % of the wider, at most 80 points below its last rule.

    Families of three rules or more are tables.
    """
    hs = rules(v).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("y", "a", "b"))).alias("hs"))
    empty = F.array().cast("array<struct<a:double,b:double,top:double,last:double,n:bigint>>")

    def step(acc, h):
        fits = lambda f: (F.least(f["b"], h["b"]) - F.greatest(f["a"], h["a"]) > 0.55 * F.greatest(f["b"] - f["a"], h["b"] - h["a"])) & (h["y"] - f["last"] <= 80)
        at = F.array_position(F.transform(acc, fits), F.lit(True))
        one = F.struct(h["a"].alias("a"), h["b"].alias("b"), h["y"].alias("top"), h["y"].alias("last"), F.lit(1).cast("long").alias("n"))
        grown = lambda f: F.struct(F.least(f["a"], h["a"]).alias("a"), F.greatest(f["b"], h["b"]).alias("b"), f["top"].alias("top"), h["y"].alias("last"), (f["n"] + 1).alias("n"))
        return F.when(at == 0, F.array_append(acc, one)).otherwise(F.transform(acc, lambda f, j: F.when(j + 1 == at, grown(f)).otherwise(f)))

    f = hs.select("page_key", F.explode(F.aggregate("hs", empty, step)).alias("f"))
    return f.select("page_key", "f.a", "f.b", "f.top", F.col("f.last").alias("bottom"), "f.n").where("n >= 3")


@operator("A18", """SELECT page_key, c.x, c.n, c.n >= 0.6 * rows AS of_part, c.n >= 0.06 * rows AS of_bounds, c.n >= 0.15 * rows AS of_headers FROM (SELECT page_key, unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(acc) > 0 AND x[1].x - acc[-1].x <= 2 THEN list_append(acc[1:len(acc) - 1], {'x': acc[-1].x, 'n': acc[-1].n + 1}) ELSE list_append(acc, x[1]) END)) AS c, rows
  FROM (SELECT page_key, list([{'x': x0, 'n': CAST(1 AS BIGINT)}] ORDER BY x0, rid) AS xs, count(DISTINCT y1) AS rows FROM bx WHERE size >= 8 GROUP BY page_key))""")
def column_bounds(v):
    """Left edges counted within two points of a cluster's first, and whether 60, 6 or 15 % of a table's rows have each."""
    g = boxes(v).where("size >= 8").groupBy("page_key").agg(F.array_sort(F.collect_list("x0")).alias("xs"), F.countDistinct("y1").alias("rows"))
    empty = F.array().cast("array<struct<x:double,n:bigint>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        more = F.struct(last["x"].alias("x"), (last["n"] + 1).alias("n"))
        return F.when((F.size(acc) > 0) & (x - last["x"] <= 2), F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), more)).otherwise(F.array_append(acc, F.struct(x.alias("x"), F.lit(1).cast("long").alias("n"))))

    c = g.select("page_key", "rows", F.explode(F.aggregate("xs", empty, step)).alias("c")).select("page_key", "rows", "c.x", "c.n")
    return c.select("page_key", "x", "n", *[(F.col("n") >= share * F.col("rows")).alias(name) for share, name in ((0.6, "of_part"), (0.06, "of_bounds"), (0.15, "of_headers"))])


@operator("X1", """SELECT page_key, col, isle, min(rid) AS first_rid, string_agg(DISTINCT txt, ' / ' ORDER BY txt) AS value, count(*) AS cells FROM (SELECT *, sum(CASE WHEN merged THEN 0 ELSE 1 END) OVER (PARTITION BY page_key, col ORDER BY y0, rid) AS isle FROM (SELECT *, CAST(floor(x0 / 90) AS BIGINT) AS col, coalesce(y0 - lag(y1) OVER (PARTITION BY page_key, CAST(floor(x0 / 90) AS BIGINT) ORDER BY y0, rid) < 30, false) AS merged FROM bx)) GROUP BY page_key, col, isle""", big="isle")
def merged_runs(v):
    """Cells of a column that no rule parts (gaps under 30 points) as one: the distinct values, joined, go to the first row."""
    o = Window.partitionBy("page_key", "col").orderBy("y0", "rid")
    r = boxes(v).withColumn("col", F.floor(F.col("x0") / 90))
    r = r.withColumn("merged", F.coalesce(F.col("y0") - F.lag("y1").over(o) < 30, F.lit(False))).withColumn("isle", F.sum(F.when(F.col("merged"), 0).otherwise(1)).over(o))
    return r.groupBy("page_key", "col", "isle").agg(F.min("rid").alias("first_rid"), F.array_join(F.array_sort(F.collect_set("txt")), " / ").alias("value"), F.count(F.lit(1)).alias("cells"))


@operator("X2", """SELECT page_key, max(bottom) AS y, arg_max(a, {'w': b - a, 'y': bottom, 'a': a}) AS a, max(b - a) AS width FROM (SELECT page_key, a, b, max(y) AS bottom FROM hr GROUP BY page_key, a, b HAVING count(*) >= 2 AND max(y) > 0.6 * 792) GROUP BY page_key""".replace("max(bottom) AS y,", "arg_max(bottom, {'w': b - a, 'y': bottom, 'a': a}) AS y,"))
def widest_frame(v):
    """The widest pair or more of equal rules whose lowest lies in the bottom 40 % of the page."""
    g = rules(v).groupBy("page_key", "a", "b").agg(F.max("y").alias("bottom"), F.count(F.lit(1)).alias("n")).where(f"n >= 2 AND bottom > {0.6 * 792!r}")
    key = F.struct(F.col("b") - F.col("a"), "bottom", "a")
    return g.groupBy("page_key").agg(F.max_by("bottom", key).alias("y"), F.max_by("a", key).alias("a"), F.max(F.col("b") - F.col("a")).alias("width"))


@operator("X4", """SELECT page_key, base, run, string_agg(txt, ' ' ORDER BY x0, rid) AS text FROM (SELECT *, sum(new) OVER (PARTITION BY page_key, base ORDER BY x0, rid) AS run FROM (SELECT *, CASE WHEN lag(x1) OVER w IS NULL THEN 0 WHEN abs(size - lag(size) OVER w) <= 0.3 AND x0 - lag(x1) OVER w <= 0.5 * size THEN 0 ELSE 1 END AS new FROM (SELECT *, sum(CASE WHEN y1 - pv > 1.2 THEN 1 ELSE 0 END) OVER (PARTITION BY page_key ORDER BY y1, rid) AS base FROM (SELECT *, lag(y1) OVER (PARTITION BY page_key ORDER BY y1, rid) AS pv FROM bx)) WINDOW w AS (PARTITION BY page_key, base ORDER BY x0, rid))) GROUP BY page_key, base, run""", big="base run")
def rejoined_words(v):
    """Word blocks of one baseline (within 1.2 points of the one before) and size (0.3) joined while gaps are at most half the size."""
    o = Window.partitionBy("page_key").orderBy("y1", "rid")
    r = boxes(v).withColumn("pv", F.lag("y1").over(o)).withColumn("base", F.sum(F.when(F.col("y1") - F.col("pv") > 1.2, 1).otherwise(0)).over(o))
    w = Window.partitionBy("page_key", "base").orderBy("x0", "rid")
    r = r.withColumn("px", F.lag("x1").over(w)).withColumn("ps", F.lag("size").over(w))
    r = r.withColumn("new", F.expr("CASE WHEN px IS NULL THEN 0 WHEN abs(size - ps) <= 0.3 AND x0 - px <= 0.5 * size THEN 0 ELSE 1 END")).withColumn("run", F.sum("new").over(w))
    return r.groupBy("page_key", "base", "run").agg(F.array_sort(F.collect_list(F.struct("x0", "rid", "txt"))).alias("ts")).select("page_key", "base", "run", F.array_join(F.col("ts.txt"), " ").alias("text"))


@operator("C4", """SELECT page_key, CAST(f.n AS BIGINT) AS lines FROM (SELECT page_key, list_reduce(ys, lambda a, y: CASE WHEN a.n = 0 OR y.s - a.s / a.c > 0.6 * y.h THEN {'s': y.s, 'c': CAST(1 AS BIGINT), 'n': a.n + 1, 'h': 0.0::DOUBLE} ELSE {'s': a.s + y.s, 'c': a.c + 1, 'n': a.n, 'h': 0.0::DOUBLE} END, {'s': 0.0::DOUBLE, 'c': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'h': 0.0::DOUBLE}) AS f
  FROM (SELECT page_key, list({'s': (y0 + y1) / 2, 'c': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'h': y1 - y0} ORDER BY y0 + y1, rid) AS ys FROM bx GROUP BY page_key))""")
def mean_lines(v):
    """Lines by running mean: a word whose middle is over 0.6 of its height from the mean of the line so far opens a new one."""
    s = boxes(v).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("m"), "rid", (F.col("y1") - F.col("y0")).alias("h")))).alias("ms"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("c"), F.lit(0).alias("n"))

    def step(a, x):
        new = (a["n"] == 0) | (x["m"] - a["s"] / a["c"] > 0.6 * x["h"])
        return F.struct(F.when(new, x["m"]).otherwise(a["s"] + x["m"]).alias("s"), F.when(new, 1).otherwise(a["c"] + 1).alias("c"), F.when(new, a["n"] + 1).otherwise(a["n"]).alias("n"))

    return s.select("page_key", F.aggregate("ms", start, step, lambda a: a["n"]).alias("lines"))


@operator("U2 X11 J28", f"""SELECT page_key, rid, kind FROM (SELECT page_key, rid, 'rotated' AS kind FROM bx WHERE n = 4 UNION ALL SELECT page_key, rid, 'block' FROM bx b WHERE n <> 4 AND size >= 9 AND NOT EXISTS (SELECT 1 FROM bx a WHERE a.page_key = b.page_key AND a.size = 8 AND n <> 4 AND {MEET}) UNION ALL SELECT page_key, rid, CASE WHEN EXISTS (SELECT 1 FROM bx a WHERE a.page_key = b.page_key AND a.size = 8 AND a.n <> 4 AND {MEET}) THEN 'line' ELSE 'orphan' END FROM bx b WHERE n <> 4 AND size <= 7
  AND (EXISTS (SELECT 1 FROM bx a WHERE a.page_key = b.page_key AND a.size = 8 AND a.n <> 4 AND {MEET}) OR NOT EXISTS (SELECT 1 FROM bx a WHERE a.page_key = b.page_key AND a.size >= 9 AND a.n <> 4 AND {MEET})))""".replace("a.size = 8 AND n <> 4", "a.size = 8 AND a.n <> 4"))
def reading_units(v):
    """Units of a page: rotated texts, blocks outside tables, lines inside tables, and lines in neither a table nor a block."""
    r = boxes(v)
    plain = r.where("n <> 4").select("page_key", "rid", "size", *BOX)
    named = lambda cond: r.where(f"n <> 4 AND {cond}").select(F.col("page_key").alias("op"), *[F.col(c).alias(f"o{c}") for c in BOX])
    meets = F.expr("page_key = op AND ox0 < x1 AND x0 < ox1 AND oy0 < y1 AND y0 < oy1")
    table, block = named("size = 8"), named("size >= 9")
    lines = plain.where("size <= 7")
    out = lambda d, kind: d.select("page_key", "rid", F.lit(kind).alias("kind"))
    orphans = lines.join(table, meets, "left_anti").join(block, meets, "left_anti")
    return out(r.where("n = 4"), "rotated").unionByName(out(plain.where("size >= 9").join(table, meets, "left_anti"), "block")).unionByName(out(lines.join(table, meets, "left_semi"), "line")).unionByName(out(orphans, "orphan"))
