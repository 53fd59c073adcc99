"""Putting pages together: flowing blocks, fitting texts, collapsing breaks, decorations, list blocks and image plans."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.operators.projections import ROMAN
from foliomill.operators.regions import boxes
from foliomill.plans.registry import VIEW_SQL, operator

# Fixed kinds of blocks with their height a line and the space behind them, in points.
BLOCKS = {"h": (20.0, 6.0), "li": (12.0, 2.0), "cap": (10.0, 4.0), "kv": (14.0, 2.0), "slot": (18.0, 4.0), "wm": (0.0, 0.0), "p": (12.0, 4.0), "gap": (6.0, 0.0)}
KIND = "CASE WHEN trim(text) = '' THEN 'gap' WHEN k = 21 THEN 'wm' WHEN k = 7 THEN 'h' WHEN k IN (17, 23) THEN 'li' WHEN k IN (0, 8, 25) THEN 'cap' WHEN k = 19 THEN 'kv' WHEN k = 20 THEN 'slot' ELSE 'p' END"
HEIGHT, BEHIND = ("CASE kind " + " ".join(f"WHEN '{n}' THEN {b[i]}" for n, b in BLOCKS.items()) + " END" for i in (0, 1))
#: Room on a page, and characters on a line.
ROOM, WIDE = 300.0, 80

VIEW_SQL["bl"] = f"SELECT doc_id, page, line_no, kind, CAST({HEIGHT} AS DOUBLE) * greatest(1, ceil(length(text) / {WIDE}.0)) AS h, CAST({BEHIND} AS DOUBLE) AS behind FROM (SELECT *, {KIND} AS kind FROM st)"


def blocks(v):
    s = v.st.withColumn("kind", F.expr(KIND))
    return s.select("doc_id", "page", "line_no", "kind", (F.expr(f"CAST({HEIGHT} AS DOUBLE)") * F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(float(WIDE))))).alias("h"), F.expr(f"CAST({BEHIND} AS DOUBLE)").alias("behind"))


def _place_sql(keys: str) -> str:
    step = f"CASE WHEN a[-1].y + x[1].h > {ROOM} AND a[-1].y > 0 THEN {{'n': x[1].n, 'h': x[1].h, 'b': x[1].b, 'top': 0.0::DOUBLE, 'y': x[1].h + x[1].b, 'p': a[-1].p + 1}} ELSE {{'n': x[1].n, 'h': x[1].h, 'b': x[1].b, 'top': a[-1].y, 'y': a[-1].y + x[1].h + x[1].b, 'p': a[-1].p}} END"
    zero = "{'n': CAST(-1 AS BIGINT), 'h': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'top': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'p': CAST(1 AS BIGINT)}"
    return f"SELECT {keys}, unnest(list_reduce(list([{{'n': line_no, 'h': h, 'b': behind, 'top': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'p': CAST(1 AS BIGINT)}}] ORDER BY line_no), lambda a, x: list_append(a, {step}), [{zero}])[2:]) AS r FROM bl GROUP BY {keys}"


def placed(df, keys):
    """The blocks of each group one under the other; one that doesn't fit opens the next page, if the page holds anything."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "h", "behind"))).alias("bs"))
    empty = F.array().cast("array<struct<n:bigint,top:double,y:double,p:bigint>>")

    def step(a, x):
        last = F.try_element_at(a, F.lit(-1))
        y, p = F.coalesce(last["y"], F.lit(0.0)), F.coalesce(last["p"], F.lit(1).cast("long"))
        full = (y + x["h"] > ROOM) & (y > 0)
        top = F.when(full, 0.0).otherwise(y)
        return F.array_append(a, F.struct(x["line_no"].alias("n"), top.alias("top"), (top + x["h"] + x["behind"]).alias("y"), F.when(full, p + 1).otherwise(p).alias("p")))

    return g.select(*keys, F.explode(F.aggregate("bs", empty, step)).alias("r"))


@operator("L5 L6", f"SELECT b.doc_id, b.line_no, b.kind, r.p AS page, r.top FROM bl b JOIN ({_place_sql('doc_id')}) p ON p.doc_id = b.doc_id AND p.r.n = b.line_no")
def flowed_blocks(v):
    """The blocks of each document (headings, paragraphs, items, captions, fields, slots, gaps) flowed over pages: page and top of each."""
    b = blocks(v)
    r = placed(b, ["doc_id"]).select("doc_id", F.col("r.n").alias("line_no"), F.col("r.p").alias("page"), "r.top")
    return b.select("doc_id", "line_no", "kind").join(r, ["doc_id", "line_no"])


@operator("Q41", f"SELECT doc_id, page, max(r.p) AS takes FROM ({_place_sql('doc_id, page')}) GROUP BY doc_id, page HAVING max(r.p) <> 1")
def fit_check(v):
    """Logical pages that take more than one page when each is laid out for itself."""
    return placed(blocks(v), ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.max("r.p").alias("takes")).where("takes <> 1")


@operator("L13", """SELECT l.doc_id, l.line_no, rtrim(l.text, ':') AS label, v.text AS value, max(6 * length(l.text)) OVER (PARTITION BY l.doc_id) AS label_width, greatest(120, 6 * length(coalesce(v.text, ''))) AS value_width FROM st l LEFT JOIN st v ON v.doc_id = l.doc_id AND v.line_no = l.line_no + 1 WHERE l.text LIKE '%:'""", big="label_width value_width")
def form_rows(v):
    """Form rows: labels with the line behind as value; labels of a document share the widest one's width, values have 120 points or more."""
    s = v.st.where("text LIKE '%:'").select("doc_id", "line_no", "text")
    value = v.st.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("text").alias("value"))
    j = s.join(value, ["doc_id", "line_no"], "left")
    widest = F.max(6 * F.length("text")).over(Window.partitionBy("doc_id"))
    return j.select("doc_id", "line_no", F.rtrim("text", F.lit(":")).alias("label"), "value", widest.alias("label_width"), F.greatest(F.lit(120), 6 * F.length(F.coalesce("value", F.lit("")))).alias("value_width"))


@operator("L11", """SELECT user_id, array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: NOT coalesce((s[i] = 'P' AND s[i + 1] = 'F' AND s[i + 2] = 'P') OR (s[i] = 'B' AND s[i + 1] = 'P' AND s[i + 2] = 'F' AND s[i + 3] = 'P'), false)), lambda i: s[i]), '') AS flow FROM (SELECT user_id, list(t ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, ['P', 'F', 'B', 'x'][CAST(event_id * 7 + user_id AS BIGINT) % 4 + 1] AS t FROM events) GROUP BY user_id)""")
def collapsed_breaks(v):
    """Flows of breaks (P) and changes to full (F) or body (B) pages without the blank page that a break before "F P" would leave."""
    t = F.element_at(F.array(*[F.lit(c) for c in "PFBx"]), ((F.col("event_id") * 7 + F.col("user_id")) % 4 + 1).cast("int"))
    s = v.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", t.alias("t")))).alias("s"))
    return s.select("user_id", F.regexp_replace(F.array_join(F.col("s.t"), ""), "B?P(?=FP)", "").alias("flow"))


@operator("L3", """SELECT page_key, rid, coalesce(list_filter(list_transform(range(0, 21), lambda i: {'s': [10.0, 9.0, 8.0, 7.0, 6.0, 5.0, 4.0][CAST(i // 3 AS BIGINT) + 1], 'g': [1.0, 1.25, 1.5][i % 3 + 1], 'k': i}), lambda e: ceil(length(txt) * 0.55 * e.s / ((x1 - x0) * e.g)) * 1.2 * e.s <= (y1 - y0) * e.g)[1].k, 21) AS attempt FROM bx""", big="attempt")
def overlay_attempts(v):
    """The first of 21 attempts (seven sizes, each in the box, a quarter and half again as large) at which a text fits its box; 21 if none."""
    tries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(g).alias("g")) for k, (s, g) in enumerate((s, g) for s in (10.0, 9.0, 8.0, 7.0, 6.0, 5.0, 4.0) for g in (1.0, 1.25, 1.5))])
    fits = lambda e: F.ceil(F.length("txt") * 0.55 * e["s"] / ((F.col("x1") - F.col("x0")) * e["g"])) * 1.2 * e["s"] <= (F.col("y1") - F.col("y0")) * e["g"]
    return boxes(v).select("page_key", "rid", F.coalesce(F.get(F.filter(tries, fits), F.lit(0))["k"], F.lit(21)).alias("attempt"))


@operator("E5 E4", """SELECT doc_id, page, CASE WHEN page = 1 THEN 'Title' WHEN page % 2 = 0 THEN 'Part ' || (doc_id % 9 + 1) || ' / ' || page ELSE page || ' / Part ' || (doc_id % 9 + 1) END AS head, CASE WHEN page > 1 THEN repeat('.', CAST(page % 5 AS INTEGER)) END AS foot FROM pg""")
def page_decorations(v):
    """What a decoration draws on each page, as a function of the page's number; made anew for every page."""
    part, page = F.concat(F.lit("Part "), (F.col("doc_id") % 9 + 1).cast("string")), F.col("page").cast("string")
    head = F.when(F.col("page") == 1, "Title").when(F.col("page") % 2 == 0, F.concat(part, F.lit(" / "), page)).otherwise(F.concat(page, F.lit(" / "), part))
    return v.pg.select("doc_id", "page", head.alias("head"), F.when(F.col("page") > 1, F.repeat(F.lit("."), (F.col("page") % 5).cast("int"))).alias("foot"))


MARK = {"num": "CAST(i AS VARCHAR) || '.'", "alpha": "chr(CAST(96 + i AS INTEGER)) || '.'", "ALPHA": "chr(CAST(64 + i AS INTEGER)) || '.'", "roman": f"{list(ROMAN)}[i] || '.'", "paren": "'（' || i || '）'"}


@operator("Q02", f"SELECT p_partkey, mode, CASE mode {' '.join(f'WHEN {m!r} THEN {e}' for m, e in MARK.items())} END AS marker FROM (SELECT p_partkey, CASE WHEN block->>0 = 'ol' THEN 1 ELSE CAST(block->>1 AS BIGINT) END AS i, coalesce(CASE WHEN block->>0 = 'ol' THEN block->>2 ELSE block->>3 END, 'num') AS mode FROM (SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN '[\"ol\",[\"a\",\"b\"],\"alpha\"]' WHEN 1 THEN '[\"ol_from\",' || (p_partkey % 20 + 1) || ',[\"a\"],\"' || ['roman', 'ALPHA', 'paren'][p_partkey % 3 + 1] || '\"]' WHEN 2 THEN '[\"ol\",[\"a\"]]' ELSE '[\"ol_from\",' || (p_partkey % 20 + 1) || ',[\"a\"]]' END AS JSON) AS block FROM part))")
def list_blocks(v):
    """The first marker of list blocks: "ol" has its mode third, "ol_from" fourth behind its start; without one lists are numbered."""
    start = (F.col("p_partkey") % 20 + 1).cast("string")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("roman", "ALPHA", "paren")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    k = F.col("p_size") % 4
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    block = F.when(k == 0, json.dumps(["ol", ["a", "b"], "alpha"])).when(k == 1, text('["ol_from",', start, ',["a"],"', mode, '"]')).when(k == 2, '["ol",["a"]]').otherwise(text('["ol_from",', start, ',["a"]]'))
    b = v.part.select("p_partkey", block.alias("b"))
    at = lambda n: F.get_json_object("b", f"$[{n}]")
    plain = at(0) == "ol"
    b = b.select("p_partkey", F.when(plain, 1).otherwise(at(1).cast("int")).alias("i"), F.coalesce(F.when(plain, at(2)).otherwise(at(3)), F.lit("num")).alias("mode"))
    i, dot = F.col("i"), F.lit(".")
    marker = F.when(F.col("mode") == "num", F.concat(i.cast("string"), dot)).when(F.col("mode") == "alpha", F.concat(F.char(96 + i), dot)).when(F.col("mode") == "ALPHA", F.concat(F.char(64 + i), dot)).when(F.col("mode") == "roman", F.concat(F.element_at(F.array(*[F.lit(r) for r in ROMAN]), i), dot)).otherwise(text("（", i.cast("string"), "）"))
    return b.select("p_partkey", "mode", marker.alias("marker"))


@operator("V10", """SELECT xref, eff_dpi, factor, CASE WHEN factor = 1 THEN 0 ELSE CAST(ceil(w / 240.0) * ceil(h / 240.0) AS BIGINT) END AS tiles, w * factor AS out_w, h * factor AS out_h FROM (SELECT *, CASE WHEN eff_dpi >= 150 THEN 1 WHEN eff_dpi >= 75 THEN 2 ELSE 4 END AS factor FROM (SELECT xref, min(w) AS w, min(h) AS h, round(min(w) / max(width_pt) * 72, 6) AS eff_dpi FROM img GROUP BY xref))""", big="factor out_w out_h tiles")
def upscale_plan(v):
    """Which images are enlarged (below 150 dpi at their widest placement), by what factor, and in how many overlapping tiles."""
    g = v.img.groupBy("xref").agg(F.min("w").alias("w"), F.min("h").alias("h"), F.max("width_pt").alias("m")).withColumn("eff_dpi", F.round(F.col("w") / F.col("m") * 72, 6))
    g = g.withColumn("factor", F.when(F.col("eff_dpi") >= 150, 1).when(F.col("eff_dpi") >= 75, 2).otherwise(4))
    tiles = F.when(F.col("factor") == 1, 0).otherwise(F.ceil(F.col("w") / 240.0) * F.ceil(F.col("h") / 240.0))
    return g.select("xref", "eff_dpi", "factor", tiles.cast("long").alias("tiles"), (F.col("w") * F.col("factor")).alias("out_w"), (F.col("h") * F.col("factor")).alias("out_h"))


@operator("Y1", """SELECT doc_id, a = b AND b = c AS template FROM (SELECT doc_id, max(s) FILTER (WHERE i = 0) AS a, max(s) FILTER (WHERE i = 1) AS b, max(s) FILTER (WHERE i = 2) AS c FROM (SELECT s.doc_id, i, array_to_string(list_sort(list_distinct(list(CAST(k AS VARCHAR)))), ',') AS s FROM (SELECT doc_id, page, CASE WHEN k IN (2, 19, 20) THEN k END AS k FROM st) s JOIN (SELECT doc_id, unnest([1, (n + 1) // 2, n]) AS page, unnest([0, 1, 2]) AS i FROM (SELECT doc_id, max(page) AS n FROM st GROUP BY doc_id HAVING max(page) >= 3)) p ON p.doc_id = s.doc_id AND p.page = s.page GROUP BY s.doc_id, i) GROUP BY doc_id)""")
def template_pages(v):
    """Documents of three pages or more whose first, middle and last pages show the same set of field labels."""
    n = v.st.groupBy("doc_id").agg(F.max("page").alias("n")).where("n >= 3")
    at = n.select("doc_id", F.posexplode(F.array(F.lit(1).cast("long"), F.floor((F.col("n") + 1) / 2), F.col("n"))).alias("i", "page"))
    lab = v.st.select("doc_id", "page", F.when(F.col("k").isin(2, 19, 20), F.col("k").cast("string")).alias("k"))
    s = lab.join(at, ["doc_id", "page"]).groupBy("doc_id", "i").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("s"))
    g = s.groupBy("doc_id").agg(*[F.max(F.when(F.col("i") == i, F.col("s"))).alias(f"s{i}") for i in range(3)])
    return g.select("doc_id", ((F.col("s0") == F.col("s1")) & (F.col("s1") == F.col("s2"))).alias("template"))


@operator("T26", """SELECT p_partkey, tag, CAST(substr(d, 1, length(d) - 1) AS BIGINT) AS major, CAST(right(d, 1) AS BIGINT) AS minor, regexp_extract(name, '_v([0-9]+)', 1) AS version FROM (SELECT p_partkey, 'cu' || (100 + p_size) AS tag, CAST(100 + p_size AS VARCHAR) AS d, p_brand || '_v' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.pdf' AS name FROM part)""")
def version_tags(v):
    """Build tags as major and minor number, and the version in a file's name."""
    n = (F.col("p_size") + 100).cast("string")
    p = v.part.select("p_partkey", F.concat(F.lit("cu"), n).alias("tag"), F.concat("p_brand", F.lit("_v"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".pdf")).alias("name"))
    return p.select("p_partkey", "tag", F.regexp_extract("tag", r"^cu(\d+)\d$", 1).cast("long").alias("major"), F.regexp_extract("tag", r"(\d)$", 1).cast("long").alias("minor"), F.regexp_extract("name", "_v([0-9]+)", 1).alias("version"))


@operator("S17", """SELECT s.stem, p.name AS latest FROM (SELECT DISTINCT p_brand AS stem FROM part UNION SELECT DISTINCT p_brand || ' S' FROM part) s LEFT JOIN (SELECT stem, max(name) AS name FROM (SELECT p_brand AS stem, 'translated/' || p_brand || '_中文_v' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.pdf' AS name FROM part WHERE p_size % 2 = 0) GROUP BY stem) p ON p.stem = s.stem""")
def file_pairs(v):
    """Source files with the last version of their output by name; null where there is none."""
    src = v.part.select(F.explode(F.array("p_brand", F.concat("p_brand", F.lit(" S")))).alias("stem")).distinct()
    name = F.concat(F.lit("translated/"), "p_brand", F.lit("_中文_v"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".pdf"))
    out = v.part.where("p_size % 2 = 0").groupBy(F.col("p_brand").alias("stem")).agg(F.max(name).alias("latest"))
    return src.join(out, "stem", "left")
