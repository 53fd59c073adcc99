"""Pages as extracted: routing by measured metrics, line scans of several kinds, labels, watermarks and code points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.plans.registry import VIEW_SQL, operator

AREA = 612 * 792
PAGE = ["doc_id", "page"]


def mode(df, keys, value, weight):
    """The value with the greatest weight in each group; ties go to the smaller value."""
    g = df.groupBy(*keys, value).agg(weight.alias("_weight"))
    return g.groupBy(*keys).agg(F.max_by(value, F.struct("_weight", -F.col(value))).alias(value))


# ---------------------------------------------------------------- metrics and levels

SLOTS_SQL = """SELECT doc_id, page, CAST(sum(n) AS BIGINT) AS slots FROM (
  SELECT r.doc_id, r.page, count(*) AS n FROM (SELECT doc_id, page, (y0 + y1) / 2 AS y, x0, x1 FROM dw WHERE y1 - y0 < 0.6 AND x1 - x0 BETWEEN 25 AND 300) r WHERE NOT EXISTS (SELECT 1 FROM sw w WHERE w.doc_id = r.doc_id AND w.page = r.page AND w.x0 < r.x1 - 2 AND w.x1 > r.x0 + 2 AND ((w.y0 < r.y - 0.5 AND w.y1 > r.y - 11) OR (w.y0 < r.y + 11 AND w.y1 > r.y + 0.5)))
    AND EXISTS (SELECT 1 FROM sw w WHERE w.doc_id = r.doc_id AND w.page = r.page AND w.x0 < r.x0 - 0.5 AND w.x1 > r.x0 - 40 AND w.y0 < r.y + 2 AND w.y1 > r.y - 10) GROUP BY ALL
  UNION ALL SELECT doc_id, page, count(*) FROM sw WHERE regexp_full_match(w, '_{4,}') GROUP BY ALL
  UNION ALL SELECT doc_id, page, count(*) FROM sw c WHERE c.w LIKE '%:' AND NOT EXISTS (SELECT 1 FROM sw w WHERE w.doc_id = c.doc_id AND w.page = c.page AND w.x0 < c.x1 + 120 AND w.x1 > c.x1 + 1 AND w.y0 < c.y1 AND w.y1 > c.y0) GROUP BY ALL) GROUP BY doc_id, page"""


def slots(v):
    w = v.sw.select(*PAGE, F.col("w").alias("other"), *[F.col(c).alias(f"w{c}") for c in ("x0", "y0", "x1", "y1")])
    r = v.dw.where("y1 - y0 < 0.6 AND x1 - x0 BETWEEN 25 AND 300").select(*PAGE, "did", F.expr("(y0 + y1) / 2").alias("y"), "x0", "x1")
    meets = lambda d, where: d.alias("r").join(w.alias("w"), (F.col("r.doc_id") == F.col("w.doc_id")) & (F.col("r.page") == F.col("w.page")) & F.expr(where), "left_semi")
    lacks = lambda d, where: d.alias("r").join(w.alias("w"), (F.col("r.doc_id") == F.col("w.doc_id")) & (F.col("r.page") == F.col("w.page")) & F.expr(where), "left_anti")
    blank = lacks(r, "wx0 < x1 - 2 AND wx1 > x0 + 2 AND ((wy0 < y - 0.5 AND wy1 > y - 11) OR (wy0 < y + 11 AND wy1 > y + 0.5))")
    named = meets(blank, "wx0 < x0 - 0.5 AND wx1 > x0 - 40 AND wy0 < y + 2 AND wy1 > y - 10").select(*PAGE)
    lines = v.sw.where(F.col("w").rlike("^_{4,}$")).select(*PAGE)
    colons = lacks(v.sw.where("w LIKE '%:'").select(*PAGE, "x0", "y0", "x1", "y1"), "wx0 < x1 + 120 AND wx1 > x1 + 1 AND wy0 < y1 AND wy1 > y0").select(*PAGE)
    return named.unionByName(lines).unionByName(colons).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("slots"))


VIEW_SQL["fs"] = SLOTS_SQL
VIEW_SQL["pq"] = f"""SELECT p.doc_id, p.page, p.w > p.h AS landscape, coalesce(c.chars, 0) AS chars, coalesce(m.dom, 0) AS dom, coalesce(d.paths, 0) AS paths, coalesce(d.cbs, 0) AS cbs, coalesce(g.fig, 0.0) AS fig, coalesce(fs.slots, 0) AS form FROM pg p
  LEFT JOIN (SELECT doc_id, page, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM st GROUP BY ALL) c ON c.doc_id = p.doc_id AND c.page = p.page
  LEFT JOIN (SELECT doc_id, page, arg_max(s, n * 1000 - s) AS dom FROM (SELECT doc_id, page, CAST(round_even(size, 0) AS BIGINT) AS s, sum(length(trim(text))) AS n FROM st GROUP BY ALL) GROUP BY ALL) m ON m.doc_id = p.doc_id AND m.page = p.page
  LEFT JOIN (SELECT doc_id, page, count(*) AS paths, count(*) FILTER (WHERE x1 - x0 BETWEEN 3 AND 11 AND y1 - y0 BETWEEN 3 AND 11 AND abs((x1 - x0) - (y1 - y0)) < 2) AS cbs FROM dw GROUP BY ALL) d ON d.doc_id = p.doc_id AND d.page = p.page
  LEFT JOIN (SELECT doc_id, page, least(100.0, count(*) * 64.0 / {AREA} * 100) AS fig FROM (SELECT DISTINCT doc_id, page, cx, cy FROM (SELECT doc_id, page, cx, unnest(range(CAST(floor(y0 / 8) AS BIGINT), CAST(floor(y1 / 8) AS BIGINT) + 1)) AS cy FROM (SELECT doc_id, page, y0, y1, unnest(range(CAST(floor(x0 / 8) AS BIGINT), CAST(floor(x1 / 8) AS BIGINT) + 1)) AS cx
    FROM (SELECT doc_id, page, x0, y0, x1, y1 FROM pl UNION ALL SELECT doc_id, page, x0, y0, x1, y1 FROM dw WHERE x1 - x0 > 20 AND y1 - y0 > 20 AND (x1 - x0) * (y1 - y0) < 0.9 * {AREA})))) GROUP BY ALL) g ON g.doc_id = p.doc_id AND g.page = p.page LEFT JOIN fs ON fs.doc_id = p.doc_id AND fs.page = p.page"""


def metrics(v):
    text = v.st.groupBy(*PAGE).agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    dom = mode(v.st.withColumn("dom", F.bround("size", 0).cast("long")), PAGE, "dom", F.sum(F.length(F.trim("text"))))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    drawn = v.dw.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("paths"), F.count_if(w.between(3, 11) & h.between(3, 11) & (F.abs(w - h) < 2)).alias("cbs"))
    box = [*PAGE, "x0", "y0", "x1", "y1"]
    boxes = v.pl.select(box).unionByName(v.dw.where((w > 20) & (h > 20) & (w * h < 0.9 * AREA)).select(box))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 8), F.floor(F.col(b) / 8)))
    fig = boxes.select(*PAGE, "y0", "y1", cells("x0", "x1").alias("cx")).select(*PAGE, "cx", cells("y0", "y1").alias("cy")).distinct().groupBy(*PAGE).agg(F.least(F.lit(100.0), F.count(F.lit(1)) * 64.0 / AREA * 100).alias("fig"))
    out = v.pg.select(*PAGE, (F.col("w") > F.col("h")).alias("landscape"))
    for part in (text, dom, drawn, fig, slots(v).withColumnRenamed("slots", "form")):
        out = out.join(part, PAGE, "left")
    return out.select(*PAGE, "landscape", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chars", "dom", "paths", "cbs")], F.coalesce("fig", F.lit(0.0)).alias("fig"), F.coalesce("form", F.lit(0)).cast("long").alias("form"))


LEVEL = "CASE WHEN landscape AND (dom >= 18 OR (dom >= 12 AND chars < 500 AND fig >= 50)) THEN 'S' WHEN fig >= 70 OR paths >= 3000 OR cbs >= 15 OR form >= 8 THEN 'P' ELSE 'R' END"


@operator("P1 P2 A1 A2", "SELECT doc_id, page, landscape, chars, dom, paths, cbs, round(fig, 6) AS fig, form FROM pq")
def page_metrics(v):
    """Characters, dominant size, drawings, checkboxes, share covered by art, form slots and orientation of each page, all measured."""
    return metrics(v).withColumn("fig", F.round("fig", 6))


@operator("P3 J6 J7", "SELECT doc_id, page, slots FROM fs")
def form_slots(v):
    """Slots to fill in: blank rules with a label to the left, runs of underscores, and words with a colon and nothing behind."""
    return slots(v)


@operator("P4", f"SELECT doc_id, page, {LEVEL} AS level FROM pq")
def page_level(v):
    """The level of each page from its metrics: slides before drawings and forms before plain text."""
    return metrics(v).select(*PAGE, F.expr(LEVEL).alias("level"))


@operator("P5 J39 E7 Z1", f"""SELECT pq.doc_id, page, CASE WHEN j.level = 'blank' AND conf >= 0.8 THEN 'R' WHEN conf >= 0.8 THEN j.level ELSE {LEVEL} END AS level, CASE WHEN conf >= 0.8 AND j.level <> {LEVEL} THEN {LEVEL} END AS heur_level
  FROM pq LEFT JOIN (SELECT doc_id, max(level) AS level, max(conf) AS conf FROM jd GROUP BY doc_id) j ON j.doc_id = pq.doc_id""")
def model_override(v):
    """A judgement of confidence 0.8 or more replaces the rule's level, which is then kept beside it."""
    j = v.jd.groupBy("doc_id").agg(F.max("level").alias("jl"), F.max("conf").alias("conf"))
    p, sure = metrics(v).withColumn("heur", F.expr(LEVEL)).join(j, "doc_id", "left"), F.col("conf") >= 0.8
    out = F.when(sure & (F.col("jl") == "blank"), "R").when(sure, F.col("jl")).otherwise(F.col("heur"))
    return p.select(*PAGE, out.alias("level"), F.when(sure & (F.col("jl") != F.col("heur")), F.col("heur")).alias("heur_level"))


@operator("P6 A3 A23", f"""SELECT doc_id, n, r, p, s, CASE WHEN mean_chars < 200 AND mean_fig < 70 THEN 'R-scan' WHEN s >= 0.6 * n THEN 'S' WHEN p > 0 AND r > 0 THEN 'H' WHEN p > 0 THEN 'P' ELSE 'R' END AS level
  FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE lv = 'R') AS r, count(*) FILTER (WHERE lv = 'P') AS p, count(*) FILTER (WHERE lv = 'S') AS s, avg(chars) AS mean_chars, avg(fig) AS mean_fig FROM (SELECT *, {LEVEL} AS lv FROM pq) GROUP BY doc_id)""")
def document_level(v):
    """The level of a document from the counts of its pages' levels."""
    g = metrics(v).withColumn("lv", F.expr(LEVEL)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("lv") == x).alias(x.lower()) for x in "RPS"], F.avg("chars").alias("mc"), F.avg("fig").alias("mf"))
    out = F.when((F.col("mc") < 200) & (F.col("mf") < 70), "R-scan").when(F.col("s") >= 0.6 * F.col("n"), "S").when((F.col("p") > 0) & (F.col("r") > 0), "H").when(F.col("p") > 0, "P").otherwise("R")
    return g.select("doc_id", "n", "r", "p", "s", out.alias("level"))


@operator("A28 Z3", f"SELECT truth, pred, count(*) AS n FROM (SELECT {LEVEL} AS pred, j.level AS truth FROM pq JOIN (SELECT doc_id, max(level) AS level FROM jd GROUP BY doc_id) j ON j.doc_id = pq.doc_id) GROUP BY truth, pred")
def confusion(v):
    """Judged against predicted levels."""
    return metrics(v).join(v.jd.groupBy("doc_id").agg(F.max("level").alias("truth")), "doc_id").groupBy("truth", F.expr(LEVEL).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- page and line scans


@operator("S1 D1", """SELECT p.doc_id, p.page, p.w, p.h, p.rot, t.chars, t.first_line, coalesce(i.n, 0) AS images, coalesce(d.n, 0) AS drawings FROM pg p JOIN (SELECT doc_id, page, CAST(sum(length(trim(text))) AS BIGINT) AS chars, arg_min(substr(trim(text), 1, 70), line_no) FILTER (WHERE trim(text) <> '') AS first_line FROM st GROUP BY ALL) t ON t.doc_id = p.doc_id AND t.page = p.page
  LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM pl GROUP BY ALL) i ON i.doc_id = p.doc_id AND i.page = p.page LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM dw GROUP BY ALL) d ON d.doc_id = p.doc_id AND d.page = p.page""")
def page_probe(v):
    """One row a page: size, rotation, stripped characters, its first line that isn't blank (cut at 70), images and drawings."""
    t = F.trim("text")
    text = v.st.groupBy(*PAGE).agg(F.sum(F.length(t)).alias("chars"), F.min_by(F.substring(t, 1, 70), F.when(t != "", F.col("line_no"))).alias("first_line"))
    n = lambda df, name: df.groupBy(*PAGE).agg(F.count(F.lit(1)).alias(name))
    out = v.pg.join(text, PAGE).join(n(v.pl, "images"), PAGE, "left").join(n(v.dw, "drawings"), PAGE, "left")
    return out.fillna(0, ["images", "drawings"]).select(*PAGE, "w", "h", "rot", "chars", "first_line", "images", "drawings")


@operator("S2 D2", """SELECT t.doc_id, t.page, t.n_lines, t.n_spans, coalesce(i.n, 0) AS image_blocks FROM (SELECT doc_id, page, count(DISTINCT line_no) AS n_lines, count(*) AS n_spans FROM sw GROUP BY ALL) t LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM pl GROUP BY ALL) i ON i.doc_id = t.doc_id AND i.page = t.page""")
def page_blocks(v):
    """The page tree with its image blocks: lines of spans, opened again; blank spans and empty lines are gone."""
    tree = v.sw.groupBy(*PAGE, "line_no").agg(F.collect_list(F.struct("word_no", "w", "x0", "x1")).alias("spans")).groupBy(*PAGE).agg(F.collect_list(F.struct("line_no", "spans")).alias("lines"))
    text = tree.select(*PAGE, F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.size(x["spans"])).alias("n_spans"))
    images = v.pl.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("image_blocks"))
    return text.join(images, PAGE, "left").fillna(0, ["image_blocks"])


@operator("S7", "SELECT doc_id, page, line_no, CASE WHEN dy < -0.2 THEN 90 WHEN dy > 0.2 THEN 270 ELSE 180 END AS angle FROM st WHERE NOT (abs(dx - 1) <= 0.2 AND abs(dy) <= 0.2) AND NOT regexp_matches(font, 'WM') AND trim(text) <> ''", big="angle")
def rotated_lines(v):
    """Lines whose direction is off left-to-right by over 0.2, with their angle; watermark fonts are left out."""
    off = ~((F.abs(F.col("dx") - 1) <= 0.2) & (F.abs("dy") <= 0.2))
    return v.st.where(off & ~F.col("font").rlike("WM") & (F.trim("text") != "")).select(*PAGE, "line_no", F.when(F.col("dy") < -0.2, 90).when(F.col("dy") > 0.2, 270).otherwise(180).alias("angle"))


TURN = {
    "x0": "CASE rot WHEN 90 THEN y0 WHEN 180 THEN w - x1 WHEN 270 THEN h - y1 ELSE x0 END",
    "y0": "CASE rot WHEN 90 THEN w - x1 WHEN 180 THEN h - y1 WHEN 270 THEN x0 ELSE y0 END",
    "x1": "CASE rot WHEN 90 THEN y1 WHEN 180 THEN w - x0 WHEN 270 THEN h - y0 ELSE x1 END",
    "y1": "CASE rot WHEN 90 THEN w - x0 WHEN 180 THEN h - y0 WHEN 270 THEN x1 ELSE y1 END",
}


@operator("P7", f"SELECT doc_id, page, line_no, {', '.join(f'{e} AS {c}' for c, e in TURN.items())} FROM (SELECT s.doc_id, s.page, line_no, x0, y0, x1, y1, w, h, rot FROM st s JOIN pg p ON p.doc_id = s.doc_id AND p.page = s.page)")
def derotated_boxes(v):
    """Line boxes in the coordinates of the unturned page, whatever a page's rotation."""
    j = v.st.select(*PAGE, "line_no", "x0", "y0", "x1", "y1").join(v.pg, PAGE)
    return j.select(*PAGE, "line_no", *[F.expr(e).alias(c) for c, e in TURN.items()])


CAPTION = r"^(?:Figure|Table|图|表)\s*[0-9]+[-.][0-9]+"
CAP = f"regexp_matches(text, '{CAPTION}')"


@operator("F10", f"SELECT doc_id, line_no, text FROM st WHERE {CAP}")
def captions(v):
    """Lines that open with a figure or table number."""
    return v.st.where(F.col("text").rlike(CAPTION)).select("doc_id", "line_no", "text")


@operator("S10 X6", rf"""WITH RECURSIVE bk AS (SELECT doc_id, page, line_no // 5 AS block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, regexp_matches(arg_min(trim(text), line_no), '^(?i)(figure|fig\.?|table)\s*[0-9]') AS cap FROM st WHERE trim(text) <> '' GROUP BY ALL),
  caught AS (SELECT doc_id, page, block FROM bk WHERE cap UNION SELECT b.doc_id, b.page, b.block FROM caught c JOIN bk a ON a.doc_id = c.doc_id AND a.page = c.page AND a.block = c.block JOIN bk b ON b.doc_id = a.doc_id AND b.page = a.page AND b.y0 - a.y1 BETWEEN 0 AND 6 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.4 * least(a.x1 - a.x0, b.x1 - b.x0))
  SELECT s.doc_id, s.line_no, bk.x0 AS block_left, c.block IS NOT NULL AS caption FROM st s JOIN bk ON bk.doc_id = s.doc_id AND bk.block = s.line_no // 5 LEFT JOIN caught c ON c.doc_id = s.doc_id AND c.page = s.page AND c.block = s.line_no // 5 WHERE trim(s.text) <> ''""")
def figure_lines(v):
    """Lines with the left edge of their block and whether it is caption: by its first line, or right below a caption, to any depth."""
    lines = v.st.where("trim(text) <> ''").withColumn("block", F.floor(F.col("line_no") / 5))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    first = F.min_by(F.trim("text"), "line_no").rlike(r"^(?i)(figure|fig\.?|table)\s*[0-9]")
    blocks = lines.groupBy(*PAGE, "block").agg(*box, first.alias("cap"))
    page = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block", "x0", "y0", "x1", "y1", "cap"))).alias("bs"))
    follows = lambda a, c: c["cap"] & (a["y0"] - c["y1"]).between(0, 6) & (F.least(a["x1"], c["x1"]) - F.greatest(a["x0"], c["x0"]) > 0.4 * F.least(a["x1"] - a["x0"], c["x1"] - c["x0"]))
    keep = ("block", "x0", "y0", "x1", "y1")
    spread = lambda arr: F.transform(arr, lambda a: F.struct(*[a[c].alias(c) for c in keep], (a["cap"] | F.exists(arr, lambda c: follows(a, c))).alias("cap")))
    done = page.select(*PAGE, F.explode(F.aggregate(F.sequence(F.lit(1), F.size("bs")), F.col("bs"), lambda acc, _: spread(acc))).alias("b"))
    return lines.select(*PAGE, "line_no", "block").join(done.select(*PAGE, "b.block", F.col("b.x0").alias("block_left"), F.col("b.cap").alias("caption")), [*PAGE, "block"]).select("doc_id", "line_no", "block_left", "caption")


BULLETS = "▪●◆•"


@operator("S12 A12", f"""SELECT doc_id, line_no, CASE WHEN bul THEN substr(t, 1, 1) ELSE '' END AS bullet, CASE WHEN bul THEN ltrim(substr(t, 2)) ELSE t END AS body, x0 + 6 * (length(text) - length(ltrim(text)) + CASE WHEN bul THEN length(t) - length(ltrim(substr(t, 2))) ELSE 0 END) AS tx0, size, color, bold
  FROM (SELECT *, contains('{BULLETS}', substr(t, 1, 1)) AS bul FROM (SELECT doc_id, line_no, x0, size, CAST(color AS BIGINT) AS color, bold, replace(text, '', '•') AS text, trim(replace(text, '', '•')) AS t FROM st) WHERE t <> '')""")
def slide_lines(v):
    """Slide lines without blank ends: the bullet at their head, where the text behind it starts, and the line's style."""
    text = F.replace("text", F.lit(""), F.lit("•"))
    t = v.st.select("doc_id", "line_no", "x0", "size", "color", "bold", text.alias("text")).withColumn("t", F.trim("text")).where("t <> ''")
    t = t.withColumn("head", F.substring("t", 1, 1)).withColumn("bul", F.lit(BULLETS).contains(F.col("head"))).withColumn("rest", F.ltrim(F.expr("substr(t, 2)")))
    lead = F.length("text") - F.length(F.ltrim("text")) + F.when(F.col("bul"), F.length("t") - F.length("rest")).otherwise(0)
    return t.select("doc_id", "line_no", F.when(F.col("bul"), F.col("head")).otherwise("").alias("bullet"), F.when(F.col("bul"), F.col("rest")).otherwise(F.col("t")).alias("body"), (F.col("x0") + 6 * lead).alias("tx0"), "size", "color", "bold")


@operator("P20 X13", """SELECT u.doc_id, u.page, u.block, string_agg(trim(text), ' ' ORDER BY line_no) AS text, coalesce(arg_min(color, line_no) FILTER (WHERE color <> body), arg_min(color, line_no)) AS color, CASE WHEN count(*) > 1 AND max(x0 + x1) / 2 - min(x0 + x1) / 2 < 0.5 * (max(x0) - min(x0)) AND max(x0 + x1) / 2 - min(x0 + x1) / 2 <= greatest(4.0, 0.06 * (max(x1) - min(x0))) THEN 'center' ELSE 'left' END AS align, count(*) AS lines
  FROM (SELECT *, line_no // 5 AS block, CAST(color AS BIGINT) AS color FROM st WHERE trim(text) <> '') u JOIN (SELECT doc_id, page, arg_max(color, n * 100000000 - color) AS body FROM (SELECT doc_id, page, CAST(color AS BIGINT) AS color, sum(length(trim(text))) AS n FROM st WHERE trim(text) <> '' GROUP BY ALL) GROUP BY ALL) b ON b.doc_id = u.doc_id AND b.page = u.page GROUP BY u.doc_id, u.page, u.block""".replace("SELECT *, line_no // 5 AS block, CAST(color AS BIGINT) AS color", "SELECT * REPLACE (CAST(color AS BIGINT) AS color), line_no // 5 AS block"))
def slide_units(v):
    """Units of slides: a block's text, the first colour that isn't the page's body colour, and whether its lines are centred."""
    s = v.st.where("trim(text) <> ''").withColumn("block", F.floor(F.col("line_no") / 5)).withColumn("color", F.col("color").cast("long"))
    body = mode(s, PAGE, "color", F.sum(F.length(F.trim("text")))).withColumnRenamed("color", "body")
    mid, left = (F.col("x0") + F.col("x1")) / 2, F.col("x0")
    spread = lambda c: F.max(c) - F.min(c)
    centred = (F.count(F.lit(1)) > 1) & (spread(mid) < 0.5 * spread(left)) & (spread(mid) <= F.greatest(F.lit(4.0), 0.06 * (F.max("x1") - F.min("x0"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    other = F.min_by(F.when(F.col("color") != F.col("body"), F.col("color")), F.when(F.col("color") != F.col("body"), F.col("line_no")))
    return s.join(body, PAGE).groupBy(*PAGE, "block").agg(text.alias("text"), F.coalesce(other, F.min_by("color", "line_no")).alias("color"), F.when(centred, "center").otherwise("left").alias("align"), F.count(F.lit(1)).alias("lines"))


KEYWORDS = "UNLESS|FIN|ANG|TIR"


@operator("S13 W7", f"""SELECT doc_id, page, line_no, size FROM (SELECT n.*, max(CASE WHEN regexp_matches(upper(text), '{KEYWORDS}') THEN rn END) OVER (PARTITION BY n.doc_id, n.page) AS last FROM (SELECT t.*, row_number() OVER (PARTITION BY t.doc_id, t.page ORDER BY round_even(t.y0, 1), t.x0, t.line_no) AS rn FROM st t
  JOIN (SELECT doc_id, page, arg_min(x0, line_no) AS ax, arg_min(y0, line_no) AS ay FROM st WHERE size <= 7.4 AND contains(upper(text), 'UNLESS OTHERWISE') GROUP BY ALL) a ON a.doc_id = t.doc_id AND a.page = t.page WHERE size <= 7.4 AND trim(text) <> '' AND t.y1 >= ay - 1 AND t.x0 BETWEEN ax - 6 AND ax + 90 AND t.y0 <= ay + 130) n) WHERE rn <= last""")
def note_lines(v):
    """Small print of a drawing's note: the column under its anchor line, in reading order, up to the last line with a keyword."""
    small = v.st.where("size <= 7.4 AND trim(text) <> ''")
    anchor = small.where(F.upper("text").contains("UNLESS OTHERWISE")).groupBy(*PAGE).agg(F.min_by("x0", "line_no").alias("ax"), F.min_by("y0", "line_no").alias("ay"))
    near = small.join(anchor, PAGE).where("y1 >= ay - 1 AND x0 BETWEEN ax - 6 AND ax + 90 AND y0 <= ay + 130")
    w = Window.partitionBy(*PAGE)
    placed = near.withColumn("rn", F.row_number().over(w.orderBy(F.bround("y0", 1), "x0", "line_no")))
    last = F.max(F.when(F.upper("text").rlike(KEYWORDS), F.col("rn"))).over(w)
    return placed.withColumn("last", last).where("rn <= last").select(*PAGE, "line_no", "size")


LABEL = r"^([A-Za-z]?[0-9]+(?:-[0-9]+){0,3})\s*\|\s*P\s*a\s*g\s*e"
LABELS_SQL = f"SELECT doc_id, label, min(page) AS page FROM (SELECT doc_id, page, arg_min(regexp_extract(trim(text), '{LABEL}', 1), line_no) AS label FROM st WHERE regexp_matches(trim(text), '{LABEL}') GROUP BY ALL) GROUP BY ALL"


def labels(v):
    t = F.trim("text")
    first = v.st.where(t.rlike(LABEL)).groupBy(*PAGE).agg(F.min_by(F.regexp_extract(t, LABEL, 1), "line_no").alias("label"))
    return first.groupBy("doc_id", "label").agg(F.min("page").alias("page"))


@operator("S15 W3", LABELS_SQL)
def page_labels(v):
    """Printed page labels: the first line of a page that has the form, and the first page that shows each label."""
    return labels(v)


@operator("J22", f"""SELECT r.doc_id, r.line_no, r.printed, coalesce(l.page, CASE WHEN regexp_full_match(r.printed, '[0-9]+') THEN CAST(r.printed AS BIGINT) + 2 END) AS page FROM (SELECT doc_id, line_no, CASE WHEN k = 2 THEN regexp_extract(trim(text), '{LABEL}', 1) ELSE regexp_extract(text, '([0-9]+)$', 1) END AS printed FROM st WHERE k IN (1, 2)) r LEFT JOIN ({LABELS_SQL}) l ON l.doc_id = r.doc_id AND l.label = r.printed WHERE r.printed <> ''""")
def printed_targets(v):
    """Where a printed page number lies: on the page that bears the label, else at the number and an offset of two."""
    r = v.st.where("k IN (1, 2)").select("doc_id", "line_no", F.when(F.col("k") == 2, F.regexp_extract(F.trim("text"), LABEL, 1)).otherwise(F.regexp_extract("text", "([0-9]+)$", 1)).alias("printed")).where("printed <> ''")
    known = labels(v).withColumnRenamed("label", "printed")
    return r.join(known, ["doc_id", "printed"], "left").select("doc_id", "line_no", "printed", F.coalesce("page", F.when(F.col("printed").rlike("^[0-9]+$"), F.col("printed").try_cast("long") + 2)).alias("page"))


ROWS = {"leader": r"^(.*?)[.·…\s]{2,}([0-9]{1,3})\s*$", "sectioned": r"^(.*?)[.·…\s]{2,}([A-Za-z]?[0-9]+(?:-[0-9]+){0,3})\s*$", "code": r"^(.*?)[.·…]{2,}\s*([A-Za-z0-9][A-Za-z0-9 /-]{2,})$"}


@operator("F17", "SELECT doc_id, line_no, form, title, target FROM (SELECT doc_id, line_no, " + "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in ROWS.items()) + " END AS form, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 1)" for p in ROWS.values()) + " END AS title, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 2)" for p in ROWS.values()) + " END AS target FROM st) WHERE form IS NOT NULL")
def contents_rows(v):
    """Lines that are contents rows: leaders and a page, a sectioned page, or a code; the first form that fits."""
    hit = lambda of: F.coalesce(*[F.when(F.col("text").rlike(p), of(n, p)) for n, p in ROWS.items()])
    return v.st.select("doc_id", "line_no", hit(lambda n, p: F.lit(n)).alias("form"), hit(lambda n, p: F.regexp_extract("text", p, 1)).alias("title"), hit(lambda n, p: F.regexp_extract("text", p, 2)).alias("target")).where("form IS NOT NULL")


PAGE_NUMBER = r"^(?:[0-9]{1,4}|[ivxlc]+|[A-Za-z]?[0-9]+(?:-[0-9]+){1,3}|[A-Z]-[0-9]+)$"


@operator("F16", f"SELECT doc_id, line_no, w AS number FROM (SELECT s.doc_id, s.line_no, s.w, regexp_replace(substr(t.text, 1, length(t.text) - length(s.w)), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS body FROM (SELECT doc_id, line_no, arg_max(w, word_no) AS w FROM sw GROUP BY ALL) s JOIN st t ON t.doc_id = s.doc_id AND t.line_no = s.line_no) WHERE regexp_matches(w, '{PAGE_NUMBER}') AND length(body) >= 2")
def toc_rows(v):
    """Lines whose last span is a page number (arabic, roman, sectioned or of an appendix) behind two readable characters or more."""
    last = v.sw.groupBy("doc_id", "line_no").agg(F.max_by("w", "word_no").alias("number"))
    j = v.st.select("doc_id", "line_no", "text").join(last, ["doc_id", "line_no"])
    body = F.regexp_replace(F.expr("substr(text, 1, length(text) - length(number))"), r"[^\p{L}\p{N}]", "")
    return j.where(F.col("number").rlike(PAGE_NUMBER) & (F.length(body) >= 2)).select("doc_id", "line_no", "number")


# ---------------------------------------------------------------- marks, watermarks, code points


@operator("F5 Q09", """SELECT doc_id, line_no, n FROM (SELECT doc_id, line_no, CAST(len(list_filter(range(1, length(text) + 1), lambda i: contains(',;:!?()', text[i]) AND NOT (contains(',:', text[i]) AND regexp_matches(text[i - 1], '[0-9]') AND regexp_matches(text[i + 1], '[0-9]')))) AS BIGINT) AS n FROM st WHERE regexp_matches(text, '[一-鿿]')) WHERE n > 0""")
def halfwidth_punctuation(v):
    """Half-width marks in lines of Han text; commas and colons between digits don't count."""
    n = F.regexp_count("text", F.lit(r"[;!?()]|(?<![0-9])[,:]|[,:](?![0-9])")).cast("long")
    return v.st.where(F.col("text").rlike("[一-鿿]")).select("doc_id", "line_no", n.alias("n")).where("n > 0")


WM_SQL = "SELECT s.doc_id, s.page, s.line_no, s.text, s.x0, s.y0, s.x1, s.y1 FROM st s JOIN (SELECT doc_id, page, arg_max(z, n * 1000 - z) AS body FROM (SELECT doc_id, page, round_even(size, 1) AS z, count(*) AS n FROM st WHERE trim(text) <> '' GROUP BY ALL) GROUP BY ALL) m ON m.doc_id = s.doc_id AND m.page = s.page WHERE regexp_matches(font, 'WM') AND size >= greatest(2 * body, 20) AND trim(text) <> ''"


def watermarks(v):
    t = v.st.where("trim(text) <> ''")
    body = mode(t.withColumn("body", F.bround("size", 1)), PAGE, "body", F.count(F.lit(1)))
    return t.join(body, PAGE).where(F.col("font").rlike("WM") & (F.col("size") >= F.greatest(2 * F.col("body"), F.lit(20.0)))).select(*PAGE, "line_no", "text", "x0", "y0", "x1", "y1")


@operator("F12", f"SELECT doc_id, page, line_no FROM ({WM_SQL})")
def watermark_spans(v):
    """Spans in a watermark font of at least twice the page's most frequent size and 20 points."""
    return watermarks(v).select(*PAGE, "line_no")


@operator("F13 X16", f"""SELECT w.doc_id, w.line_no, w.word_no FROM sw w WHERE EXISTS (SELECT 1 FROM ({WM_SQL}) m WHERE m.doc_id = w.doc_id AND m.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN m.x0 AND m.x1 AND (w.y0 + w.y1) / 2 BETWEEN m.y0 - 20 AND m.y1 + 20 AND len(list_filter(string_split(m.text, ' '), lambda t: t <> '' AND contains(t, w.w))) > 0)""")
def watermark_words(v):
    """Words that are part of a token of a watermark of their page and centred in its box, grown by its slant."""
    m = watermarks(v).select(F.col("doc_id").alias("md"), F.col("page").alias("mp"), F.col("text").alias("mt"), *[F.col(c).alias(f"m{c}") for c in ("x0", "y0", "x1", "y1")])
    w = v.sw
    on = (w.doc_id == m.md) & (w.page == m.mp) & F.expr("(x0 + x1) / 2 BETWEEN mx0 AND mx1 AND (y0 + y1) / 2 BETWEEN my0 - 20 AND my1 + 20 AND exists(split(mt, ' '), t -> t <> '' AND contains(t, w))")
    return w.join(m, on, "left_semi").select("doc_id", "line_no", "word_no")


#: Code points that look like others: no-break variants, soft hyphen, compatibility ideographs, radicals.
ODD = "[‑ ­豈-﫿⺀-⿟\U0002f800-\U0002fa1f]"


@operator("F19 Q11", f"""SELECT doc_id, line_no, pos, 'U+' || upper(lpad(format('{{:x}}', unicode(text[pos])), 4, '0')) AS code, substr(text, greatest(pos - 12, 1), pos - greatest(pos - 12, 1) + 13) AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS rn FROM (SELECT doc_id, line_no, text, unnest(list_filter(range(1, length(text) + 1), lambda i: regexp_matches(text[i], '{ODD}'))) AS pos FROM st WHERE regexp_matches(text, '{ODD}'))) WHERE rn <= 50""")
def odd_codepoints(v):
    """Code points that pass for others, with twelve characters on either side; fifty of a document are listed at most."""
    found = v.st.where(F.col("text").rlike(ODD)).select("doc_id", "line_no", "text", F.posexplode(F.split("text", "")).alias("i", "ch")).where(F.col("ch").rlike(ODD)).withColumn("pos", (F.col("i") + 1).cast("long"))
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "pos"))
    listed = found.withColumn("rn", rn).where("rn <= 50")
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("ch")), 4, "0"))
    return listed.select("doc_id", "line_no", "pos", code.alias("code"), F.expr("substr(text, greatest(pos - 12, 1), pos - greatest(pos - 12, 1) + 13)").alias("context"))


# Fixed ranges of code points that are typed in technical texts, less the no-break and look-alike ones in them.
PREFERRED = ((0x20, 0x7E), (0xA1, 0xFF), (0x2000, 0x206F), (0x2100, 0x23FF), (0x2460, 0x27BF), (0x3000, 0x303F), (0xFF01, 0xFF5E), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF))
NOT_PREFERRED = (0xAD, 0x2011, 0x2007, 0x202F, 0x2027, 0x2219, 0x22C5)
IS_PREFERRED = "(" + " OR ".join(f"cp BETWEEN {a} AND {b}" for a, b in PREFERRED) + f") AND cp NOT IN {NOT_PREFERRED}"


@operator("F22", f"SELECT cp, n, {IS_PREFERRED} AS preferred FROM (SELECT CAST(unicode(ch) AS BIGINT) AS cp, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM st) WHERE ch <> '' GROUP BY ALL)")
def preferred_codepoints(v):
    """Every code point of the texts, how often it occurs, and whether it lies in the preferred ranges."""
    c = v.st.select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy(F.ascii("ch").cast("long").alias("cp")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("cp", "n", F.expr(IS_PREFERRED).alias("preferred"))


@operator("F23 A26 Q10", """SELECT s.doc_id, s.ch, s.n FROM (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM st) WHERE ch <> '' AND ch <> ' ' GROUP BY ALL) s WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE lang = 'en') f WHERE f.ch = s.ch)""")
def missing_glyphs(v):
    """Characters of a document that a font lacks whose map holds the characters of the English texts."""
    chars = v.st.select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> '' AND ch <> ' '").groupBy("doc_id", "ch").agg(F.count(F.lit(1)).alias("n"))
    font = v.documents.where("lang = 'en'").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).distinct()
    return chars.join(font, "ch", "left_anti").select("doc_id", "ch", "n")


@operator("O9 S25", """SELECT doc_id, arg_min(font, missing * 100 + pref) AS font, min(missing) AS missing FROM (SELECT d.doc_id, f.font, f.pref, count(*) FILTER (WHERE m.ch IS NULL) AS missing FROM (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS ch FROM documents) d, (VALUES ('en', 0), ('de', 1), ('fr', 2), ('es', 3)) f(font, pref) LEFT JOIN (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents) m ON m.lang = f.font AND m.ch = d.ch WHERE d.ch <> '' GROUP BY ALL) GROUP BY doc_id""")
def font_choice(v):
    """The font of each document: fewest missing characters first, then the order of preference; a font holds its language's characters."""
    fonts = F.explode(F.array(*[F.struct(F.lit(f).alias("font"), F.lit(k).alias("pref")) for k, f in enumerate(("en", "de", "fr", "es"))]))
    chars = v.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''")
    held = v.documents.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).groupBy("ch").agg(F.collect_set("lang").alias("langs"))
    each = chars.join(held, "ch", "left").select("doc_id", "langs", fonts.alias("f")).select("doc_id", "langs", "f.font", "f.pref")
    n = each.groupBy("doc_id", "font", "pref").agg(F.count_if(~F.array_contains("langs", F.col("font"))).alias("missing"))
    return n.groupBy("doc_id").agg(F.min_by("font", F.struct("missing", "pref")).alias("font"), F.min("missing").alias("missing"))


@operator("Y11", r"SELECT doc_id, line_no, regexp_extract(text, '\*\*[^*\n]{1,20}\*\*') AS mark FROM st WHERE regexp_matches(text, '\*\*[^*\n]{1,20}\*\*')")
def stray_emphasis(v):
    """Markdown emphasis left in output text."""
    p = r"\*\*[^*\n]{1,20}\*\*"
    return v.st.where(F.col("text").rlike(p)).select("doc_id", "line_no", F.regexp_extract("text", p, 0).alias("mark"))


# ---------------------------------------------------------------- body size, columns, heads


BASE_SQL = "SELECT doc_id, page, CASE WHEN sum(n) < 5 THEN 9.0 ELSE arg_max(z, n * 1000 - z) END AS base FROM (SELECT doc_id, page, round_even(size * 2, 0) / 2 AS z, count(*) AS n FROM st WHERE length(trim(text)) >= 15 AND NOT bold GROUP BY ALL) GROUP BY doc_id, page"
LEFTS_SQL = "SELECT doc_id, page, list(step * 1.2) AS lefts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, step) AS rn FROM (SELECT doc_id, page, round_even(x0 / 1.2, 0) AS step, count(*) AS n FROM st WHERE trim(text) <> '' GROUP BY ALL)) WHERE rn <= 3 AND n >= 6 GROUP BY doc_id, page"


@operator("A6 A7 F11", f"SELECT s.doc_id, s.line_no FROM st s LEFT JOIN ({BASE_SQL}) b ON b.doc_id = s.doc_id AND b.page = s.page LEFT JOIN ({LEFTS_SQL}) l ON l.doc_id = s.doc_id AND l.page = s.page WHERE trim(text) <> '' AND (abs(size - coalesce(base, 9.0)) <= 0.75 OR coalesce(len(list_filter(lefts, lambda e: abs(x0 - e) <= 1.5)), 0) > 0)")
def prose_test(v):
    """Lines of body size, or that start at a column edge.

    Body size: the most frequent half-point size of lines of 15 characters or more that aren't bold, 9 where there are fewer than five.
    Column edges: the three most frequent left edges (in steps of 1.2) with six lines or more.
    """
    long = v.st.where("length(trim(text)) >= 15 AND NOT bold").select(*PAGE, (F.bround(F.col("size") * 2, 0) / 2).alias("z")).groupBy(*PAGE, "z").agg(F.count(F.lit(1)).alias("n"))
    base = long.groupBy(*PAGE).agg(F.when(F.sum("n") < 5, 9.0).otherwise(F.max_by("z", F.struct("n", -F.col("z")))).alias("base"))
    step = F.bround(F.col("x0") / 1.2, 0)
    edges = v.st.where("trim(text) <> ''").groupBy(*PAGE, step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    top = edges.withColumn("rn", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "step"))).where("rn <= 3 AND n >= 6")
    lefts = top.groupBy(*PAGE).agg(F.collect_list(F.col("step") * 1.2).alias("lefts"))
    j = v.st.where("trim(text) <> ''").join(base, PAGE, "left").join(lefts, PAGE, "left")
    near = F.coalesce(F.exists("lefts", lambda e: F.abs(F.col("x0") - e) <= 1.5), F.lit(False))
    return j.where((F.abs(F.col("size") - F.coalesce("base", F.lit(9.0))) <= 0.75) | near).select("doc_id", "line_no")


@operator("A4", "SELECT doc_id, list_sort(list(x)) AS lefts FROM (SELECT doc_id, round_even(x0, 0) AS x FROM st WHERE trim(text) <> '' GROUP BY ALL HAVING count(*) >= 20) GROUP BY doc_id")
def body_margins(v):
    """Left edges that twenty lines of a document or more share."""
    x = v.st.where("trim(text) <> ''").groupBy("doc_id", F.bround("x0", 0).alias("x")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return x.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("lefts"))


@operator("A27", "SELECT DISTINCT a.doc_id, a.page, a.text AS head FROM st a JOIN st b ON a.doc_id = b.doc_id AND a.text = b.text AND round_even(a.y0, 0) = round_even(b.y0, 0) AND (b.page = a.page + 1 OR b.page = a.page - 1) WHERE trim(a.text) <> ''")
def running_heads(v):
    """Lines that stand at the same height on a neighbouring page."""
    t = v.st.where("trim(text) <> ''").select(*PAGE, "text", F.bround("y0", 0).alias("y"))
    b = t.select("doc_id", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page"), "text", "y")
    return t.join(b, [*PAGE, "text", "y"], "left_semi").select(*PAGE, F.col("text").alias("head")).distinct()


@operator("W11 Q21", """SELECT doc_id, tag, p0, coalesce(lead(p0) OVER (PARTITION BY doc_id ORDER BY p0) - 1, n) AS p1 FROM (SELECT doc_id, min(tag) AS tag, p0, n FROM (SELECT s.doc_id, arg_min(split_part(text, ' ', 1), line_no) AS tag, page AS p0, any_value(n) AS n FROM st s JOIN (SELECT doc_id, max(page) AS n FROM st GROUP BY ALL) m ON m.doc_id = s.doc_id WHERE k = 7 GROUP BY s.doc_id, page) GROUP BY ALL)""")
def appendix_spans(v):
    """Parts of a document: each begins on the page of its heading and ends right before the next one, the last on the last page."""
    n = v.st.groupBy("doc_id").agg(F.max("page").alias("n"))
    starts = v.st.where("k = 7").groupBy("doc_id", F.col("page").alias("p0")).agg(F.min_by(F.split_part("text", F.lit(" "), F.lit(1)), "line_no").alias("tag"))
    nxt = F.lead("p0").over(Window.partitionBy("doc_id").orderBy("p0")) - 1
    return starts.join(n, "doc_id").select("doc_id", "tag", "p0", F.coalesce(nxt, "n").alias("p1"))


# Fixed pairs of private-use code points of symbol fonts (as offsets from U+F000) and what they stand for.
SYMBOLS = {
    0x20: " ", 0x61: "α", 0x62: "β", 0x67: "γ", 0x64: "δ", 0x65: "ε", 0x71: "θ", 0x6C: "λ", 0x6D: "μ", 0x70: "π", 0x73: "σ", 0x74: "τ", 0x6A: "φ", 0x77: "ω", 0x44: "Δ", 0x53: "Σ", 0x57: "Ω",
    0xB0: "°", 0xB1: "±", 0xB4: "×", 0xB8: "÷", 0xA3: "≤", 0xB3: "≥", 0xB9: "≠", 0xB7: "•", 0xA7: "▪", 0xFC: "✓", 0xDE: "→", 0xDF: "←", 0xE0: "→", 0x6E: "▪", 0x75: "◆", 0xD8: "▶", 0x9F: "•",
}
FROM, TO = "".join(chr(0xF000 + k) for k in SYMBOLS), "".join(SYMBOLS.values())


@operator("T5", f"SELECT doc_id, line_no, translate(text, '{FROM}', '{TO}') AS text, regexp_matches(translate(text, '{FROM}', '{TO}'), '[-]') AS residue FROM st")
def symbol_code_points(v):
    """Private-use code points of all lines as what they stand for, and whether any is left."""
    return v.st.select("doc_id", "line_no", F.translate("text", FROM, TO).alias("text")).withColumn("residue", F.col("text").rlike("[-]"))


@operator("X10", """SELECT doc_id, line_no, part, string_agg(w, ' ' ORDER BY word_no) AS text FROM (SELECT *, sum(CASE WHEN gap > greatest(0.75 * size, 1.5 * mid) OR boxed THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS part FROM (SELECT g.*, median_up AS mid, EXISTS (SELECT 1 FROM dw b WHERE b.doc_id = g.doc_id AND b.page = g.page AND b.x1 - b.x0 BETWEEN 3 AND 11 AND b.y1 - b.y0 BETWEEN 3 AND 11 AND b.x0 >= g.x0 - g.gap AND b.x1 <= g.x0 AND b.y0 < g.y1 AND b.y1 > g.y0) AS boxed
  FROM (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS gap FROM sw) g LEFT JOIN (SELECT doc_id, line_no, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median_up FROM (SELECT doc_id, line_no, x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS gap FROM sw) WHERE gap IS NOT NULL GROUP BY ALL) m ON m.doc_id = g.doc_id AND m.line_no = g.line_no)) GROUP BY doc_id, line_no, part""", big="part")
def split_lines(v):
    """Lines parted where a gap exceeds three quarters of the size and half again the line's usual gap, or holds a checkbox."""
    o = Window.partitionBy("doc_id", "line_no").orderBy("word_no")
    g = v.sw.withColumn("gap", F.col("x0") - F.lag("x1").over(o))
    gaps = F.array_sort(F.collect_list("gap"))
    m = g.where("gap IS NOT NULL").groupBy("doc_id", "line_no").agg(F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")).alias("mid"))
    b = v.dw.where("x1 - x0 BETWEEN 3 AND 11 AND y1 - y0 BETWEEN 3 AND 11").select(F.col("doc_id").alias("bd"), F.col("page").alias("bp"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    held = g.where("gap > 0").alias("g").join(b, F.expr("doc_id = bd AND page = bp AND bx0 >= x0 - gap AND bx1 <= x0 AND by0 < y1 AND by1 > y0"), "left_semi").select("doc_id", "line_no", "word_no", F.lit(True).alias("boxed"))
    full = g.join(m, ["doc_id", "line_no"], "left").join(held, ["doc_id", "line_no", "word_no"], "left")
    new = F.when((F.col("gap") > F.greatest(0.75 * F.col("size"), 1.5 * F.col("mid"))) | F.coalesce("boxed", F.lit(False)), 1).otherwise(0)
    parted = full.withColumn("new", new).withColumn("part", F.sum("new").over(o))
    return parted.groupBy("doc_id", "line_no", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "w"))), lambda x: x["w"]), " ").alias("text"))


@operator("X14", """SELECT doc_id, block, run, string_agg(trim(text), ' ' ORDER BY line_no) AS text, min(size) AS size FROM (SELECT s.*, line_no // 5 AS block, len(list_filter(f.cuts, lambda c: c <= line_no)) AS run FROM st s JOIN (SELECT doc_id, line_no // 5 AS block, list_transform(list_reduce(list([{'s': size, 'n': line_no}] ORDER BY line_no), lambda a, x: CASE WHEN x[1].s / a[-1].s >= 1.4 OR a[-1].s / x[1].s >= 1.4 THEN list_append(a, x[1]) ELSE a END), lambda e: e.n) AS cuts FROM st WHERE trim(text) <> '' GROUP BY ALL) f ON f.doc_id = s.doc_id AND f.block = s.line_no // 5 WHERE trim(text) <> '') GROUP BY doc_id, block, run""", big="run")
def sized_blocks(v):
    """Blocks of lines parted where the size is 1.4 times that of the part's first line or more, or less; each part as one text."""
    s = v.st.where("trim(text) <> ''").withColumn("block", F.floor(F.col("line_no") / 5))
    g = s.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "size", F.trim("text").alias("t")))).alias("ls"))
    empty = F.array().cast("array<struct<line_no:bigint,size:double>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))["size"]
        return F.when(last.isNull() | (x["size"] / last >= 1.4) | (last / x["size"] >= 1.4), F.array_append(acc, F.struct(x["line_no"].alias("line_no"), x["size"].alias("size")))).otherwise(acc)

    cut = g.select("doc_id", "block", "ls", F.aggregate("ls", empty, step).alias("cuts"))
    run = cut.select("doc_id", "block", "cuts", F.explode("ls").alias("l")).select("doc_id", "block", "l.*", F.size(F.filter("cuts", lambda c: c["line_no"] <= F.col("l.line_no"))).cast("long").alias("run"))
    return run.groupBy("doc_id", "block", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ").alias("text"), F.min("size").alias("size"))


@operator("X15", f"""WITH wm AS ({WM_SQL}), rects AS (SELECT doc_id, page, x0, y0, x1, y1 FROM dw WHERE item = 're' AND fill = 'none' AND x1 - x0 > 20),
  hit AS (SELECT DISTINCT w.doc_id, w.page, w.line_no, w.word_no, w.w, w.y0, w.y1, w.x0, w.x1 FROM sw w JOIN (SELECT * FROM rects UNION ALL SELECT doc_id, page, x0, y0 - 20, x1, y1 + 20 FROM wm) r ON r.doc_id = w.doc_id AND r.page = w.page AND w.x0 < r.x1 AND w.x1 > r.x0 AND w.y0 < r.y1 AND w.y1 > r.y0)
  SELECT h.doc_id, h.line_no, h.word_no, h.w FROM hit h WHERE NOT EXISTS (SELECT 1 FROM rects r WHERE r.doc_id = h.doc_id AND r.page = h.page AND (h.x0 + h.x1) / 2 BETWEEN r.x0 AND r.x1 AND (h.y0 + h.y1) / 2 BETWEEN r.y0 AND r.y1) AND NOT EXISTS (SELECT 1 FROM wm WHERE wm.doc_id = h.doc_id AND wm.line_no = h.line_no)
  AND NOT EXISTS (SELECT 1 FROM sw a WHERE a.doc_id = h.doc_id AND a.page = h.page AND a.w = h.w AND round_even(a.x0, 0) = round_even(h.x0, 0) AND round_even(a.y0, 0) = round_even(h.y0, 0) AND a.line_no % 2 = 0)""")
def rescued_glyphs(v):
    """Words that erasing would hit though they lie in no written box, less those still there afterwards (here: on even lines).

    Watermarks are erased too, and aren't saved themselves.
    """
    w, wm = v.sw, watermarks(v)
    rects = v.dw.where("item = 're' AND fill = 'none' AND x1 - x0 > 20").select(*PAGE, "x0", "y0", "x1", "y1")
    grown = wm.select(*PAGE, "x0", (F.col("y0") - 20).alias("y0"), "x1", (F.col("y1") + 20).alias("y1"))
    named = lambda df: df.select(F.col("doc_id").alias("rd"), F.col("page").alias("rp"), *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    page = "doc_id = rd AND page = rp AND "
    hit = w.join(named(rects.unionByName(grown)), F.expr(page + "x0 < rx1 AND x1 > rx0 AND y0 < ry1 AND y1 > ry0"), "left_semi")
    spared = hit.join(named(rects), F.expr(page + "(x0 + x1) / 2 BETWEEN rx0 AND rx1 AND (y0 + y1) / 2 BETWEEN ry0 AND ry1"), "left_anti").join(wm.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti")
    spot = lambda df: df.withColumn("rx", F.bround("x0", 0)).withColumn("ry", F.bround("y0", 0))
    alive = spot(w.where("line_no % 2 = 0")).select(*PAGE, "w", "rx", "ry").distinct()
    return spot(spared).join(alive, [*PAGE, "w", "rx", "ry"], "left_anti").select("doc_id", "line_no", "word_no", "w")
