"""Dictionary, spatial, band, nearest-neighbour and text joins. Spatial joins are equal on the page, with the geometry as the rest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.operators.scans import first_values
from foliomill.plans.registry import operator

BOX = ("x0", "y0", "x1", "y1")


def pair(v, more=()):
    """rc joined by page with a second copy whose columns start with b."""
    a = v.rc
    b = v.rc.select(F.col("page_key").alias("pk"), *[F.col(c).alias(f"b{c}") for c in ("rid", *BOX, "size", "txt", *more)])
    return a, b, (a.page_key == b.pk) & (F.col("rid") != F.col("brid"))


def shared_area():
    return F.greatest(F.least("x1", "bx1") - F.greatest("x0", "bx0"), F.lit(0)) * F.greatest(F.least("y1", "by1") - F.greatest("y0", "by0"), F.lit(0))


def area(p=""):
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
PAIR = "rc a JOIN rc b ON a.page_key = b.page_key AND a.rid <> b.rid"
FIRST = "(SELECT key, arg_min(value, batch) AS value FROM dk WHERE value IS NOT NULL GROUP BY key)"


@operator("J1 J3 E1", f"""SELECT page, unit_no, CASE WHEN page % 10 = 0 AND x0 < 50 THEN 'override' ELSE value END AS value, CASE WHEN page % 10 = 0 AND x0 < 50 THEN 'context' WHEN value IS NULL THEN 'miss' WHEN value = '' THEN 'keep' ELSE 'hit' END AS verdict FROM un LEFT JOIN {FIRST} d ON d.key = un.text""")
def dictionary_lookup(v):
    """Units with their value; a rule for a place on a page goes before the dictionary; null is a miss, empty keeps."""
    j = v.un.join(first_values(v).select(F.col("key").alias("text"), "value"), "text", "left")
    here = (F.col("page") % 10 == 0) & (F.col("x0") < 50)
    verdict = F.when(here, "context").when(F.col("value").isNull(), "miss").when(F.col("value") == "", "keep").otherwise("hit")
    return j.select("page", "unit_no", F.when(here, "override").otherwise(F.col("value")).alias("value"), verdict.alias("verdict"))


@operator("J4", f"""SELECT cell, coalesce(w.value, s.value, l.joined) AS value, CASE WHEN w.value IS NOT NULL THEN 'whole' WHEN s.value IS NOT NULL THEN 'spaced' WHEN l.joined IS NOT NULL THEN 'lines' END AS step
  FROM (SELECT DISTINCT upper(CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', chr(10)) ELSE p_name || chr(10) || p_name END) AS cell FROM part) c LEFT JOIN {FIRST} w ON w.key = cell LEFT JOIN {FIRST} s ON s.key = replace(cell, chr(10), ' ')
  LEFT JOIN (SELECT cell AS lcell, CASE WHEN count(*) = count(value) THEN string_agg(value, chr(10) ORDER BY i) END AS joined FROM (SELECT cell, unnest(string_split(cell, chr(10))) AS line, generate_subscripts(string_split(cell, chr(10)), 1) AS i FROM (SELECT DISTINCT upper(CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', chr(10)) ELSE p_name || chr(10) || p_name END) AS cell FROM part)) LEFT JOIN {FIRST} d ON d.key = line GROUP BY cell) l ON l.lcell = cell""")
def cell_lookup(v):
    """Cells looked up whole, then with line breaks as blanks, then line by line."""
    nl = F.lit("\n")
    cell = F.upper(F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), nl)).otherwise(F.concat("p_name", nl, "p_name")))
    c, d = v.part.select(cell.alias("cell")).distinct(), first_values(v).select("key", "value")
    whole = c.join(d.select(F.col("key").alias("cell"), F.col("value").alias("w")), "cell", "left")
    spaced = whole.withColumn("sk", F.replace("cell", nl, F.lit(" "))).join(d.select(F.col("key").alias("sk"), F.col("value").alias("s")), "sk", "left")
    lines = c.select("cell", F.posexplode(F.split("cell", "\n")).alias("i", "line")).join(d.select(F.col("key").alias("line"), "value"), "line", "left")
    joined = lines.groupBy("cell").agg(F.when(F.count(F.lit(1)) == F.count("value"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]), "\n")).alias("l"))
    return spaced.join(joined, "cell", "left").select("cell", F.coalesce("w", "s", "l").alias("value"), F.when(F.col("w").isNotNull(), "whole").when(F.col("s").isNotNull(), "spaced").when(F.col("l").isNotNull(), "lines").alias("step"))


@operator("J8", f"SELECT DISTINCT a.page_key, a.rid FROM {PAIR} WHERE b.size >= 9 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1 AND a.y0 - b.y1 BETWEEN 0 AND 60")
def graphic_above(v):
    """Lines with a graphic within 60 points above that overlaps them sideways."""
    a, b, same = pair(v)
    return a.join(b, same & (F.col("bsize") >= 9) & (F.least("x1", "bx1") - F.greatest("x0", "bx0") > 1) & (F.col("y0") - F.col("by1")).between(0, 60), "left_semi").select("page_key", "rid")


@operator("J9 X3", f"SELECT a.page_key, a.rid AS word, min(b.rid) AS cell, count(*) AS cells FROM {PAIR} WHERE (a.x0 + a.x1) / 2 >= b.x0 AND (a.x0 + a.x1) / 2 < b.x1 AND (a.y0 + a.y1) / 2 >= b.y0 AND (a.y0 + a.y1) / 2 < b.y1 GROUP BY a.page_key, a.rid")
def point_in_cell(v):
    """Words by the cells their centres lie in."""
    a, b, same = pair(v)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return a.join(b, same & (cx >= F.col("bx0")) & (cx < F.col("bx1")) & (cy >= F.col("by0")) & (cy < F.col("by1"))).groupBy("page_key", F.col("rid").alias("word")).agg(F.min("brid").alias("cell"), F.count(F.lit(1)).alias("cells"))


@operator("J10 J11", "SELECT v.page_key, v.k, v.a, v.b, count(*) AS crossed FROM sg v JOIN sg h ON v.page_key = h.page_key AND v.axis = 'V' AND h.axis = 'H' AND h.k BETWEEN v.a - 1.5 AND v.b + 1.5 AND v.k BETWEEN h.a - 1.5 AND h.b + 1.5 GROUP BY ALL HAVING count(*) >= 2", big="k")
def vertical_rules(v):
    """Vertical segments that at least two horizontal ones cross."""
    s = v.sg.where("axis = 'V'").drop("axis")
    h = v.sg.where("axis = 'H'").select("page_key", F.col("k").alias("hk"), F.col("a").alias("ha"), F.col("b").alias("hb"))
    # each vertical is dealt to the integer positions it spans on its page, so the join is equal on page and position
    top = h.groupBy("page_key").agg(F.max("hk").alias("top"), F.min("hk").alias("low"))
    lo, hi = F.greatest(F.ceil(F.col("a") - 1.5), F.col("low")), F.least(F.floor(F.col("b") + 1.5), F.col("top"))
    dealt = s.join(top, "page_key").where(lo <= hi).select("page_key", "k", "a", "b", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("hk"))
    crossing = dealt.join(h, ["page_key", "hk"]).where(F.col("k").between(F.col("ha") - 1.5, F.col("hb") + 1.5))
    return crossing.groupBy("page_key", "k", "a", "b").agg(F.count(F.lit(1)).alias("crossed")).where("crossed >= 2")



@operator("J13 Q03 M1", f"""SELECT text, count(*) AS n, list(page ORDER BY page)[1:4] AS pages FROM (SELECT DISTINCT text, page FROM un WHERE kind < 2) u WHERE NOT EXISTS (SELECT 1 FROM {FIRST} d WHERE d.key = u.text) GROUP BY text""")
def label_coverage(v):
    """Labels without a value, with up to four of the pages that show them."""
    u = v.un.where("kind < 2").select("text", "page").distinct()
    return u.join(first_values(v).select(F.col("key").alias("text")), "text", "left_anti").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("page")), 1, 4).alias("pages"))


@operator("J14 Q04 U3", "SELECT stem, side FROM (SELECT DISTINCT regexp_extract(target, '([^/]+)$', 1) AS stem, 'missing' AS side FROM toc WHERE regexp_extract(target, '([^/]+)$', 1) NOT IN (SELECT regexp_extract(url, '([^/]+)$', 1) FROM pages) UNION ALL SELECT DISTINCT regexp_extract(url, '([^/]+)$', 1), 'unused' FROM pages WHERE regexp_extract(url, '([^/]+)$', 1) NOT IN (SELECT regexp_extract(target, '([^/]+)$', 1) FROM toc))")
def asset_differences(v):
    """Files that are linked but not there, and files that are there but not linked."""
    tail = lambda c, side: F.regexp_extract(c, r"([^/]+)$", 1).alias("stem")
    used, have = v.toc.select(tail("target", 0)).distinct(), v.pages.select(tail("url", 0)).distinct()
    return used.join(have, "stem", "left_anti").withColumn("side", F.lit("missing")).unionByName(have.join(used, "stem", "left_anti").withColumn("side", F.lit("unused")))


#: Tokens that must survive as they are: runs of letters, digits and joints that hold a digit.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-./,]*[A-Za-z0-9]|[0-9]"
TOKENS_SQL = f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents) WHERE regexp_matches(token, '[0-9]') AND length(token) >= 2 GROUP BY ALL"


def document_tokens(v):
    t = v.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("token"))
    return t.where(F.col("token").rlike("[0-9]") & (F.length("token") >= 2)).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@operator("A8 T11", TOKENS_SQL)
def token_counts(v):
    """Tokens with a digit of each document, by number of occurrences."""
    return document_tokens(v)


@operator("J15 Q12", f"""SELECT t.doc_id, t.token, t.n FROM ({TOKENS_SQL}) t JOIN (SELECT doc_id, regexp_replace(string_agg(text, ' ' ORDER BY line_no), '\\s', '', 'g') AS out FROM st GROUP BY doc_id) o ON o.doc_id = t.doc_id WHERE NOT contains(o.out, t.token)""")
def token_reconciliation(v):
    """Tokens of a document that its whole output lacks, even as part of something longer; blanks don't count."""
    out = v.st.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    out = out.select("doc_id", F.regexp_replace(F.array_join(F.col("ls.text"), " "), r"\s", "").alias("out"))
    return document_tokens(v).join(out, "doc_id").where(~F.col("out").contains(F.col("token"))).select("doc_id", "token", "n")


@operator("J16 Q16 W6 T14 J38 U4", """SELECT doc_id, token, n FROM (SELECT doc_id, token, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY token) AS rn FROM (SELECT DISTINCT s.doc_id, s.token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9.]*[0-9][A-Za-z0-9.]*')) AS token FROM documents) s
  JOIN (SELECT doc_id - 1 AS doc_id, regexp_replace(text, '\\s', '', 'g') AS out FROM documents) o ON o.doc_id = s.doc_id WHERE NOT contains(out, token))) WHERE rn <= 6""")
def kept_tokens_missing(v):
    """Tokens with a digit that the paired document lacks; six of each at most, with their number."""
    src = v.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9.]*[0-9][A-Za-z0-9.]*"), 0))).alias("token"))
    out = v.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.regexp_replace("text", r"\s", "").alias("out"))
    lost = src.join(out, "doc_id").where(~F.col("out").contains(F.col("token"))).select("doc_id", "token")
    w = Window.partitionBy("doc_id")
    return lost.select("doc_id", "token", F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(w.orderBy("token")).alias("rn")).where("rn <= 6").drop("rn")


@operator("J17", "SELECT u.page, u.unit_no FROM (SELECT *, max(size) OVER (PARTITION BY page) AS hi, min(size) OVER (PARTITION BY page) AS lo FROM un) u WHERE hi >= 1.4 * lo AND size = lo AND kind >= 2 AND NOT EXISTS (SELECT 1 FROM un o WHERE o.page = u.page + 1 AND contains(o.text, u.text))")
def cross_size_rows(v):
    """Kept rows in the small size of pages that mix sizes by 1.4 or more, and that the output (the page one on) doesn't show."""
    w = Window.partitionBy("page")
    small = v.un.select("page", "unit_no", "text", "size", "kind", F.max("size").over(w).alias("hi"), F.min("size").over(w).alias("lo")).where("hi >= 1.4 * lo AND size = lo AND kind >= 2")
    out = v.un.select((F.col("page") - 1).alias("op"), F.col("text").alias("ot"))
    return small.join(out, (F.col("page") == F.col("op")) & F.col("ot").contains(F.col("text")), "left_anti").select("page", "unit_no")


@operator("J23", f"""SELECT a.page_key, a.rid, arg_min(b.rid, {{'x': b.x0, 'r': b.rid}}) AS line_rid FROM {PAIR} WHERE a.size = 6 AND b.size > 6 AND abs(a.y1 - b.y1) <= 3 AND b.x0 >= a.x1 - 80 AND b.x0 - a.x1 <= 60 GROUP BY a.page_key, a.rid""")
def marker_lines(v):
    """The line that belongs to a bullet set apart: the nearest to its right on the baseline (3 points) whose start is at most 60 points off."""
    a, b, same = pair(v)
    near = F.expr("size = 6 AND bsize > 6 AND abs(y1 - by1) <= 3 AND bx0 >= x1 - 80 AND bx0 - x1 <= 60")
    return a.join(b, same & near).groupBy("page_key", "rid").agg(F.min_by("brid", F.struct("bx0", "brid")).alias("line_rid"))


@operator("J18", """SELECT a.page_key, a.rid, arg_min(b.rid, b.x0 * 1000 + b.rid) AS right_rid FROM rc a JOIN rc b ON a.page_key = b.page_key AND a.rid <> b.rid AND abs(a.y1 - b.y1) <= 0.6 * (a.y1 - a.y0) AND b.x0 >= a.x1 GROUP BY a.page_key, a.rid""")
def nearest_right(v):
    """The nearest rectangle to the right on the same baseline."""
    a, b, same = pair(v)
    return a.join(b, same & (F.abs(F.col("y1") - F.col("by1")) <= 0.6 * (F.col("y1") - F.col("y0"))) & (F.col("bx0") >= F.col("x1"))).groupBy("page_key", "rid").agg(F.min_by("brid", F.struct("bx0", "brid")).alias("right_rid"))


@operator("J19", f"""SELECT a.page_key, a.rid, coalesce(min(b.rid) FILTER (WHERE {SHARED} >= 0.3 * ((b.x1 - b.x0) * (b.y1 - b.y0))), min(b.rid) FILTER (WHERE (b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1)) AS row_rid FROM rc a LEFT JOIN rc b ON a.page_key = b.page_key AND a.rid <> b.rid GROUP BY a.page_key, a.rid""")
def link_rows(v):
    """The row a link belongs to: one it covers by 30 %, else one whose centre it holds."""
    a, b, same = pair(v)
    by_area = F.min(F.when(shared_area() >= 0.3 * area("b"), F.col("brid")))
    inside = ((F.col("bx0") + F.col("bx1")) / 2).between(F.col("x0"), F.col("x1")) & ((F.col("by0") + F.col("by1")) / 2).between(F.col("y0"), F.col("y1"))
    return a.join(b, same, "left").groupBy("page_key", "rid").agg(F.coalesce(by_area, F.min(F.when(inside, F.col("brid")))).alias("row_rid"))


KEYWORD = r"[\u2E80-\u9FFF]{2,}|[a-z]{4,}"


@operator("J20 Q24 T13", """SELECT t.page_id, t.ord, t.kw, p.page_id AS goal FROM (SELECT page_id, ord, printed, list_reduce(regexp_extract_all(lower(title), '[\\x{2E80}-\\x{9FFF}]{2,}|[a-z]{4,}'), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END, '') AS kw FROM te) t JOIN pages p ON CAST(p.page_id AS VARCHAR) = t.printed WHERE kw <> '' AND NOT contains(lower(regexp_replace(p.html, '<[^>]*>', ' ', 'g')), kw)""")
def toc_target_check(v):
    """Entries whose longest keyword (two Han characters or four letters at least; the first of the longest) isn't in their target's text."""
    kw = F.aggregate(F.regexp_extract_all(F.lower("title"), F.lit(KEYWORD), 0), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    t = v.te.select("page_id", "ord", "printed", kw.alias("kw")).where("kw <> ''")
    body = v.pages.select(F.col("page_id").alias("goal"), F.col("page_id").cast("string").alias("printed"), F.lower(F.regexp_replace("html", "<[^>]*>", " ")).alias("body"))
    return t.join(body, "printed").where(~F.col("body").contains(F.col("kw"))).select("page_id", "ord", "kw", "goal")


@operator("J21 S14", """SELECT code, arg_min(doc_id, {'d': doc_id, 'p': page}) AS doc_id, arg_min(page, {'d': doc_id, 'p': page}) AS page FROM (SELECT DISTINCT regexp_extract(text, '^([0-9]+-[0-9]+|[A-Z]+ [0-9]+)', 1) AS code FROM st WHERE regexp_matches(text, '^([0-9]+-[0-9]+|[A-Z]+ [0-9]+)')) c JOIN (SELECT doc_id, page, text FROM st WHERE y0 < 130) b ON starts_with(b.text, c.code) GROUP BY code""")
def code_first_page(v):
    """The first page with a head line that starts with a code.

    A head line is dealt to its beginnings of the lengths that codes have, so the join is an equal one.
    """
    p = r"^([0-9]+-[0-9]+|[A-Z]+ [0-9]+)"
    codes = v.st.where(F.col("text").rlike(p)).select(F.regexp_extract("text", p, 1).alias("code")).distinct()
    longest = codes.agg(F.max(F.length("code")).alias("m")).first()["m"] or 0  # a code's length, one number
    heads = v.st.where("y0 < 130").select("doc_id", "page", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length("text"), F.lit(longest)), F.lit(1))), lambda n: F.substr("text", F.lit(1), n))).alias("code"))
    return codes.join(heads, "code").groupBy("code").agg(F.min(F.struct("doc_id", "page")).alias("m")).select("code", "m.doc_id", "m.page")


@operator("J40 Q43", """SELECT page_key, box, problem FROM (SELECT page_key, rid - 1 AS box, 'unlisted' AS problem FROM rc WHERE NOT EXISTS (SELECT 1 FROM (SELECT page_key AS pk, l_linenumber - 1 AS b FROM rc) l WHERE l.pk = page_key AND l.b = rid - 1) UNION ALL SELECT DISTINCT page_key, CAST(l_linenumber - 1 AS BIGINT), 'no box' FROM rc a WHERE NOT EXISTS (SELECT 1 FROM (SELECT page_key AS pk, rid - 1 AS b FROM rc) l WHERE l.pk = a.page_key AND l.b = a.l_linenumber - 1))""")
def unlisted_boxes(v):
    """Detected boxes that no label lists by its index, and labels for boxes that aren't there; both are errors."""
    box = v.rc.select("page_key", (F.col("rid") - 1).cast("long").alias("box")).distinct()
    label = v.rc.select("page_key", (F.col("l_linenumber") - 1).cast("long").alias("box")).distinct()
    on = ["page_key", "box"]
    return box.join(label, on, "left_anti").withColumn("problem", F.lit("unlisted")).unionByName(label.join(box, on, "left_anti").withColumn("problem", F.lit("no box")))


@operator("J26 Q36", f"""SELECT a.page_key, a.rid FROM rc a WHERE a.size <= 8 AND NOT EXISTS (SELECT 1 FROM rc b WHERE a.page_key = b.page_key AND a.rid <> b.rid AND b.size > 8 AND greatest(least(a.x1, b.x1 + 6) - greatest(a.x0, b.x0 - 6), 0) * greatest(least(a.y1, b.y1 + 6) - greatest(a.y0, b.y0 - 6), 0) >= 0.55 * ((a.x1 - a.x0) * (a.y1 - a.y0)))""")
def sweep_uncovered(v):
    """Detected boxes that no handled box, grown by 6 points, covers by 55 %."""
    a, b, same = pair(v)
    grown = F.greatest(F.least(F.col("x1"), F.col("bx1") + 6) - F.greatest(F.col("x0"), F.col("bx0") - 6), F.lit(0)) * F.greatest(F.least(F.col("y1"), F.col("by1") + 6) - F.greatest(F.col("y0"), F.col("by0") - 6), F.lit(0))
    return a.where("size <= 8").join(b, same & (F.col("bsize") > 8) & (grown >= 0.55 * area()), "left_anti").select("page_key", "rid")


@operator("J27", f"SELECT DISTINCT a.page_key, a.rid FROM {PAIR} WHERE {SHARED} >= 0.3 * ((a.x1 - a.x0) * (a.y1 - a.y0)) OR ({SHARED} > 0 AND contains(b.txt, a.txt) AND a.txt <> b.txt)")
def claimed_units(v):
    """Units claimed by another one: by 30 % of their area, or touching it as a proper part of its text."""
    a, b, same = pair(v)
    return a.join(b, same & ((shared_area() >= 0.3 * area()) | ((shared_area() > 0) & F.col("btxt").contains(F.col("txt")) & (F.col("txt") != F.col("btxt")))), "left_semi").select("page_key", "rid")


@operator("J30", f"""SELECT page_key, unit, n, CASE WHEN n < 2 THEN -1 WHEN sx0 <= tol THEN 0 WHEN sx1 <= tol THEN 2 WHEN sm <= tol THEN 1 ELSE -1 END AS align FROM (SELECT b.page_key, b.rid AS unit, count(*) AS n, max(a.x0) - min(a.x0) AS sx0, max(a.x1) - min(a.x1) AS sx1, max(a.x0 + a.x1) / 2 - min(a.x0 + a.x1) / 2 AS sm, greatest(3, 0.1 * any_value(b.x1 - b.x0)) AS tol FROM {PAIR} WHERE a.size < 9 AND b.size >= 9 AND {SHARED} > 0.5 * ((a.x1 - a.x0) * (a.y1 - a.y0)) GROUP BY b.page_key, b.rid)""", big="align")
def unit_alignment(v):
    """The alignment of the lines that lie in a unit by over half their area: left 0, centred 1, right 2, else -1."""
    a, b, same = pair(v)
    j = a.where("size < 9").join(b.where("bsize >= 9"), same & (shared_area() > 0.5 * area()))
    spread = lambda c: F.max(c) - F.min(c)
    g = j.groupBy("page_key", F.col("brid").alias("unit"), "bx0", "bx1").agg(F.count(F.lit(1)).alias("n"), spread(F.col("x0")).alias("sx0"), spread(F.col("x1")).alias("sx1"), spread((F.col("x0") + F.col("x1")) / 2).alias("sm"))
    tol = F.greatest(F.lit(3.0), 0.1 * (F.col("bx1") - F.col("bx0")))
    return g.select("page_key", "unit", "n", F.when(F.col("n") < 2, -1).when(F.col("sx0") <= tol, 0).when(F.col("sx1") <= tol, 2).when(F.col("sm") <= tol, 1).otherwise(-1).alias("align"))


@operator("A14", "SELECT page_key, CASE WHEN n < 2 THEN -1 WHEN max(x0) - min(x0) <= greatest(3, 0.1 * max(x1 - x0)) THEN 0 WHEN max(x1) - min(x1) <= greatest(3, 0.1 * max(x1 - x0)) THEN 2 WHEN max(x0 + x1) / 2 - min(x0 + x1) / 2 <= greatest(3, 0.1 * max(x1 - x0)) THEN 1 ELSE -1 END AS align FROM (SELECT *, count(*) OVER (PARTITION BY page_key) AS n FROM rc) GROUP BY page_key, n", big="align")
def block_alignment(v):
    """Left, right, centred or none, by the spread of edges and middles."""
    spread = lambda c: F.max(c) - F.min(c)
    tol = F.greatest(F.lit(3), 0.1 * F.max(F.col("x1") - F.col("x0")))
    return v.rc.groupBy("page_key").agg(F.when(F.count(F.lit(1)) < 2, -1).when(spread(F.col("x0")) <= tol, 0).when(spread(F.col("x1")) <= tol, 2).when(spread((F.col("x0") + F.col("x1")) / 2) <= tol, 1).otherwise(-1).alias("align"))


@operator("J32 G10", """SELECT s.doc_id, s.line_no, least(576.0, coalesce(min(o.x0), 1e9) - 5) AS right_limit, count(o.x0) AS obstacles FROM st s LEFT JOIN (SELECT doc_id, page, line_no, x0, y0, y1 FROM st WHERE trim(text) <> '' UNION ALL SELECT doc_id, page, -1, x0, y0, y1 FROM dw WHERE x1 - x0 BETWEEN 3 AND 11 OR x1 - x0 <= 3) o ON o.doc_id = s.doc_id AND o.page = s.page AND o.line_no <> s.line_no AND o.x0 > s.x0 AND o.y0 < s.y1 AND o.y1 > s.y0 WHERE trim(s.text) <> '' GROUP BY s.doc_id, s.line_no""")
def widening_limit(v):
    """How far a line may widen: to the next line, checkbox or vertical rule at its height, less 5 points, or the margin."""
    t = v.st.where("trim(text) <> ''")
    o = t.select("doc_id", "page", "line_no", "x0", "y0", "y1").unionByName(v.dw.where("x1 - x0 BETWEEN 3 AND 11 OR x1 - x0 <= 3").select("doc_id", "page", F.lit(-1).cast("long").alias("line_no"), "x0", "y0", "y1"))
    o = o.select(F.col("doc_id").alias("od"), F.col("page").alias("op"), F.col("line_no").alias("ol"), F.col("x0").alias("ox0"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"))
    j = t.join(o, F.expr("doc_id = od AND page = op AND ol <> line_no AND ox0 > x0 AND oy0 < y1 AND oy1 > y0"), "left")
    return j.groupBy("doc_id", "line_no").agg(F.least(F.lit(576.0), F.coalesce(F.min("ox0"), F.lit(1e9)) - 5).alias("right_limit"), F.count("ox0").alias("obstacles"))


@operator("G10", "SELECT a.page_key, a.rid, least(576.0, coalesce(min(b.x0) FILTER (WHERE b.x0 > a.x0 AND b.y0 < a.y1 AND b.y1 > a.y0), 1e9) - 5) AS right_limit FROM rc a LEFT JOIN rc b ON a.page_key = b.page_key AND a.rid <> b.rid GROUP BY a.page_key, a.rid")
def right_limit(v):
    """How far each rectangle may widen: to the nearest obstacle at its height, or the margin."""
    a, b, same = pair(v)
    hit = (F.col("bx0") > F.col("x0")) & (F.col("by0") < F.col("y1")) & (F.col("by1") > F.col("y0"))
    return a.join(b, same, "left").groupBy("page_key", "rid").agg(F.least(F.lit(576.0), F.coalesce(F.min(F.when(hit, F.col("bx0"))), F.lit(1e9)) - 5).alias("right_limit"))


@operator("J33", f"SELECT a.page_key, a.rid, b.rid AS around FROM {PAIR} WHERE (a.x1 - a.x0) * (a.y1 - a.y0) < (b.x1 - b.x0) * (b.y1 - b.y0) AND {SHARED} >= 0.8 * ((a.x1 - a.x0) * (a.y1 - a.y0)) AND NOT contains(b.txt, a.txt) AND (a.x0 - b.x0 <= 6 OR b.x1 - a.x1 <= 6)")
def edge_intruders(v):
    """Smaller units that lie in a larger one by 80 %, at its left or right edge, with a text of their own."""
    a, b, same = pair(v)
    at_edge = (F.col("x0") - F.col("bx0") <= 6) | (F.col("bx1") - F.col("x1") <= 6)
    on = same & (area() < area("b")) & (shared_area() >= 0.8 * area()) & ~F.col("btxt").contains(F.col("txt")) & at_edge
    return a.join(b, on).select("page_key", "rid", F.col("brid").alias("around"))


@operator("J34 L9", "SELECT a.page_key, a.rid, min(b.y0) AS next_y, least(792.0, coalesce(min(b.y0), 792.0)) - a.y1 AS room FROM rc a LEFT JOIN rc b ON a.page_key = b.page_key AND a.rid <> b.rid AND b.y0 >= a.y1 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.25 * (a.x1 - a.x0) GROUP BY a.page_key, a.rid, a.y1")
def room_below(v):
    """The nearest unit below that overlaps by a quarter of the width, and the room down to it."""
    a, b, same = pair(v)
    j = a.join(b, same & (F.col("by0") >= F.col("y1")) & (F.least("x1", "bx1") - F.greatest("x0", "bx0") > 0.25 * (F.col("x1") - F.col("x0"))), "left")
    return j.groupBy("page_key", "rid", "y1").agg(F.min("by0").alias("next_y")).select("page_key", "rid", "next_y", (F.least(F.lit(792.0), F.coalesce("next_y", F.lit(792.0))) - F.col("y1")).alias("room"))


@operator("J35 Q15 G1 G2", f"SELECT a.page_key, a.rid AS a_rid, b.rid AS b_rid, {SHARED} AS shared FROM rc a JOIN rc b ON a.page_key = b.page_key AND a.rid < b.rid WHERE {SHARED} > 0.15 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.3 * least(a.y1 - a.y0, b.y1 - b.y0)")
def rect_overlap_pairs(v):
    """Pairs of a page that overlap by 15 % of the smaller and 30 % of the lower height."""
    a, b, _ = pair(v)
    high = F.least("y1", "by1") - F.greatest("y0", "by0") > 0.3 * F.least(F.col("y1") - F.col("y0"), F.col("by1") - F.col("by0"))
    return a.join(b, (a.page_key == b.pk) & (F.col("rid") < F.col("brid")) & (shared_area() > 0.15 * F.least(area(), area("b"))) & high).select("page_key", F.col("rid").alias("a_rid"), F.col("brid").alias("b_rid"), shared_area().alias("shared"))


@operator("Q33", """SELECT s.doc_id, s.page FROM (SELECT p.doc_id, p.page, w, h, coalesce(n, 0) AS n FROM pg p LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM dw GROUP BY ALL) d ON d.doc_id = p.doc_id AND d.page = p.page) s JOIN (SELECT p.doc_id - 1 AS doc_id, p.page, w, h, coalesce(n, 0) AS n FROM pg p LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM dw GROUP BY ALL) d ON d.doc_id = p.doc_id AND d.page = p.page) o ON o.doc_id = s.doc_id AND o.page = s.page WHERE s.w <> o.w OR s.h <> o.h OR o.n < s.n - 2""")
def layout_changes(v):
    """Pages of paired documents whose size differs, or that lost more than two drawings."""
    n = v.dw.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    p = v.pg.join(n, ["doc_id", "page"], "left").fillna(0, ["n"])
    o = p.select((F.col("doc_id") - 1).alias("doc_id"), "page", F.col("w").alias("ow"), F.col("h").alias("oh"), F.col("n").alias("on"))
    return p.join(o, ["doc_id", "page"]).where(F.expr("w <> ow OR h <> oh OR `on` < n - 2")).select("doc_id", "page")



@operator("J41 M2", """SELECT p.p_partkey, coalesce(l.p_size, p.p_size) AS size, CASE WHEN l.p_partkey IS NULL THEN 'own' ELSE 'like' END AS origin FROM part p LEFT JOIN part l ON l.p_partkey = CASE WHEN p.p_partkey % 4 = 0 THEN p.p_partkey // 4 END""", big="size")
def like_reference(v):
    """Rows that take their geometry from another one they name."""
    like = v.part.select(F.col("p_partkey").alias("ref"), F.col("p_size").alias("ls"))
    p = v.part.withColumn("want", F.when(F.col("p_partkey") % 4 == 0, F.floor(F.col("p_partkey") / 4)))
    return p.join(like, p.want == like.ref, "left").select("p_partkey", F.coalesce("ls", "p_size").alias("size"), F.when(F.col("ref").isNull(), "own").otherwise("like").alias("origin"))


@operator("J42", "SELECT a.p_partkey AS alias_of, a.p_size FROM part a WHERE a.p_size % 7 <> 0 AND EXISTS (SELECT 1 FROM part b WHERE b.p_type = a.p_type AND b.p_brand = a.p_brand AND b.p_size % 7 = 0)", big="p_size")
def glyph_aliases(v):
    """Code points that aren't preferred but share a glyph with one that is."""
    good = v.part.where("p_size % 7 = 0").select("p_type", "p_brand").distinct()
    return v.part.where("p_size % 7 <> 0").join(good, ["p_type", "p_brand"], "left_semi").select(F.col("p_partkey").alias("alias_of"), "p_size")
