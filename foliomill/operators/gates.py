"""Audit queries. Each returns violations; no rows means the gate is passed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.operators.joins import BOX
from foliomill.operators.pages import LABEL, captions, halfwidth_punctuation, missing_glyphs, odd_codepoints, stray_emphasis
from foliomill.plans.registry import ORACLES, operator


@operator("Q08", f"""SELECT p.doc_id, p.page, CASE WHEN l.label IS NULL THEN 'no label' ELSE 'out of sequence' END AS fault FROM pg p LEFT JOIN (SELECT doc_id, page, arg_min(regexp_extract(trim(text), '{LABEL}', 1), line_no) AS label FROM st WHERE regexp_matches(trim(text), '{LABEL}') GROUP BY ALL) l ON l.doc_id = p.doc_id AND l.page = p.page WHERE l.label IS NULL OR l.label <> (p.doc_id % 9 + 1) || '-' || p.page""")
def page_sequence_gap(v):
    """Pages without a printed label, or whose label isn't their part and place in the sequence."""
    t = F.trim("text")
    found = v.st.where(t.rlike(LABEL)).groupBy("doc_id", "page").agg(F.min_by(F.regexp_extract(t, LABEL, 1), "line_no").alias("label"))
    want = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("-"), F.col("page").cast("string"))
    p = v.pg.select("doc_id", "page").join(found, ["doc_id", "page"], "left").where(F.col("label").isNull() | (F.col("label") != want))
    return p.select("doc_id", "page", F.when(F.col("label").isNull(), "no label").otherwise("out of sequence").alias("fault"))


@operator("Q13 T21", r"""SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '^[,.;:!?)\]]') THEN 'head' ELSE 'tail' END AS side FROM ln WHERE regexp_matches(text, '^[,.;:!?)\]]') OR regexp_matches(text, '[(\[|]$')""", big="line_no")
def line_prohibitions(v):
    """Lines that begin or end with a mark that mayn't."""
    head = F.col("text").rlike(r"^[,.;:!?)\]]")
    return v.ln.where(head | F.col("text").rlike(r"[(\[|]$")).select("doc_id", "line_no", F.when(head, "head").otherwise("tail").alias("side"))


@operator("Q17 J36", "SELECT r.page_key, r.rid, count(*) AS residue FROM rc r JOIN rc t ON r.page_key = t.page_key AND r.rid <> t.rid AND r.size = 10 AND greatest(least(r.x1, t.x1) - greatest(r.x0, t.x0), 0) * greatest(least(r.y1, t.y1) - greatest(r.y0, t.y0), 0) BETWEEN 1 AND 0.9 * ((t.x1 - t.x0) * (t.y1 - t.y0)) GROUP BY r.page_key, r.rid")
def clip_residue(v):
    """Figure clips that cut texts: some of a text, not nearly all, lies in the clip."""
    r = v.rc.where("size = 10").select("page_key", "rid", *BOX)
    t = v.rc.select(F.col("page_key").alias("pk"), *[F.col(c).alias(f"t{c}") for c in ("rid", *BOX)])
    s = F.greatest(F.least("x1", "tx1") - F.greatest("x0", "tx0"), F.lit(0)) * F.greatest(F.least("y1", "ty1") - F.greatest("y0", "ty0"), F.lit(0))
    area = (F.col("tx1") - F.col("tx0")) * (F.col("ty1") - F.col("ty0"))
    return r.join(t, (r.page_key == t.pk) & (F.col("rid") != F.col("trid")) & s.between(F.lit(1), 0.9 * area)).groupBy("page_key", "rid").agg(F.count(F.lit(1)).alias("residue"))


PAGE_STATE = "SELECT p.doc_id, p.page, coalesce(t.lines, 0) AS lines, coalesce(t.chars, 0) AS chars, coalesce(i.n, 0) AS images, coalesce(d.n, 0) AS drawings FROM pg p LEFT JOIN (SELECT doc_id, page, count(*) FILTER (WHERE trim(text) <> '') AS lines, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM st GROUP BY ALL) t ON t.doc_id = p.doc_id AND t.page = p.page LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM pl GROUP BY ALL) i ON i.doc_id = p.doc_id AND i.page = p.page LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM dw GROUP BY ALL) d ON d.doc_id = p.doc_id AND d.page = p.page"


def page_state(v):
    text = v.st.groupBy("doc_id", "page").agg(F.count_if(F.trim("text") != "").alias("lines"), F.sum(F.length(F.trim("text"))).alias("chars"))
    n = lambda df, name: df.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias(name))
    on = ["doc_id", "page"]
    return v.pg.select(on).join(text, on, "left").join(n(v.pl, "images"), on, "left").join(n(v.dw, "drawings"), on, "left").fillna(0)


@operator("Q20", f"SELECT doc_id, page, lines FROM ({PAGE_STATE}) WHERE lines BETWEEN 1 AND 2 AND images = 0 AND drawings <= 12")
def thin_pages(v):
    """Pages of one or two lines without images and with at most twelve drawings."""
    return page_state(v).where("lines BETWEEN 1 AND 2 AND images = 0 AND drawings <= 12").select("doc_id", "page", "lines")


@operator("Y9", f"SELECT doc_id, page, CASE WHEN chars = 0 THEN 'blank' ELSE 'orphan' END AS kind FROM ({PAGE_STATE}) WHERE chars <= 60 AND images = 0")
def orphan_pages(v):
    """Pages without images that are blank or hold at most 60 characters."""
    return page_state(v).where("chars <= 60 AND images = 0").select("doc_id", "page", F.when(F.col("chars") == 0, "blank").otherwise("orphan").alias("kind"))


@operator("Q23", """SELECT page_id, ord, CASE WHEN x1 - x0 < 20 THEN 'narrow' WHEN h < 6 THEN 'flat' WHEN y0 < prev THEN 'overlap' END AS fault FROM (SELECT *, lag(y0 + h) OVER (PARTITION BY page_id ORDER BY ord) AS prev FROM (SELECT page_id, ord, 54.0 AS x0, 54.0 + 6 * length(title) AS x1, 100.0 + 14 * ord AS y0, CASE WHEN ord % 7 = 3 THEN 18.0 WHEN ord % 9 = 4 THEN 4.0 ELSE 12.0 END AS h FROM te)) WHERE x1 - x0 < 20 OR h < 6 OR y0 < prev""")
def link_rects(v):
    """Link rectangles of contents pages that are too narrow or flat, or reach into the entry below."""
    h = F.when(F.col("ord") % 7 == 3, 18.0).when(F.col("ord") % 9 == 4, 4.0).otherwise(12.0)
    t = v.te.select("page_id", "ord", (6 * F.length("title")).alias("w"), (100.0 + 14 * F.col("ord")).alias("y0"), h.alias("h"))
    t = t.withColumn("prev", F.lag(F.col("y0") + F.col("h")).over(Window.partitionBy("page_id").orderBy("ord")))
    fault = F.when(F.col("w") < 20, "narrow").when(F.col("h") < 6, "flat").when(F.col("y0") < F.col("prev"), "overlap")
    return t.select("page_id", "ord", fault.alias("fault")).where("fault IS NOT NULL")


@operator("G1", "SELECT a.page_key, a.rid AS a_rid, b.rid AS b_rid FROM rc a JOIN rc b ON a.page_key = b.page_key AND a.rid < b.rid AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) > 0.05 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))")
def link_overlap(v):
    """Pairs of links that overlap by over 5 % of the smaller."""
    a = v.rc.select("page_key", F.col("rid").alias("a_rid"), *BOX)
    b = v.rc.select("page_key", F.col("rid").alias("b_rid"), *[F.col(c).alias(f"b{c}") for c in BOX])
    s = F.greatest(F.least("x1", "bx1") - F.greatest("x0", "bx0"), F.lit(0)) * F.greatest(F.least("y1", "by1") - F.greatest("y0", "by0"), F.lit(0))
    smaller = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")))
    return a.join(b, "page_key").where((F.col("a_rid") < F.col("b_rid")) & (s > 0.05 * smaller)).select("page_key", "a_rid", "b_rid")


@operator("Q28", r"SELECT page_id, ord, title, x1 > 612 AS off_page FROM (SELECT *, 54 + 6 * length(title) + 12 * ord AS x1 FROM te) WHERE x1 > 612 OR (regexp_matches(title, '[A-Za-z]{3}') AND NOT regexp_matches(title, '^(Home|About)'))")
def toc_residual(v):
    """Contents entries that still hold Latin words, or run off the page."""
    off = 54 + 6 * F.length("title") + 12 * F.col("ord") > 612
    return v.te.where(off | (F.col("title").rlike("[A-Za-z]{3}") & ~F.col("title").rlike("^(Home|About)"))).select("page_id", "ord", "title", off.alias("off_page"))


@operator("Q27", r"SELECT t.page_id, t.ord, k.token FROM te t, (SELECT unnest(['API', 'ISO', '1.0', '2.0', '3.0']) AS token) k JOIN pages p ON true WHERE p.page_id = t.page_id AND contains(t.title, k.token) AND NOT contains(regexp_replace(p.html, '<[^>]*>', ' ', 'g'), k.token)")
def toc_kept_items(v):
    """Kept tokens of contents entries that the page's text lacks."""
    tokens = F.filter(F.array(*[F.lit(t) for t in ("API", "ISO", "1.0", "2.0", "3.0")]), lambda t: F.contains(F.col("title"), t))
    t = v.te.select("page_id", "ord", F.explode(tokens).alias("token"))
    body = v.pages.select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("body"))
    return t.join(body, "page_id").where(~F.col("body").contains(F.col("token"))).select("page_id", "ord", "token")


@operator("Q42", "SELECT doc_id, pages, want, pages <> want AS wrong FROM (SELECT doc_id, max(page) AS pages, CAST(ceil(count(*) / 20.0) AS BIGINT) + CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END AS want FROM st GROUP BY doc_id)")
def page_count_check(v):
    """The pages of each document against the number it must have; strict() makes the same a failure."""
    want = F.ceil(F.count(F.lit(1)) / 20.0) + F.when(F.col("doc_id") % 50 == 7, 1).otherwise(0)
    return v.st.groupBy("doc_id").agg(F.max("page").alias("pages"), want.alias("want")).withColumn("wrong", F.col("pages") != F.col("want"))


def strict(counts):
    """counts (pages, want), failing the job where they differ."""
    return counts.select("*", F.assert_true(F.col("pages") == F.col("want"), F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" has the wrong number of pages"))).alias("_ok")).where("_ok IS NULL").drop("_ok")


def _gates():
    """Name, query and SQL of every gate that reports violations by document."""
    from foliomill.operators import filters, joins

    qs = [page_sequence_gap, line_prohibitions, thin_pages, orphan_pages, halfwidth_punctuation, missing_glyphs, odd_codepoints, stray_emphasis, joins.token_reconciliation, joins.kept_tokens_missing, joins.layout_changes, filters.residual_english, filters.stray_rules]
    return {q.__name__: q for q in qs}


GATES = _gates()


@operator("Q30 Q45 D22", "SELECT doc_id, gates, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM (SELECT doc_id, list(DISTINCT gate ORDER BY gate) FILTER (WHERE gate <> '') AS gates, count(*) FILTER (WHERE gate <> '') AS violations FROM (SELECT doc_id, '' AS gate FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, '{n}' FROM ({ORACLES[n]})" for n in GATES) + ") GROUP BY doc_id)")
def corpus_verdict(v):
    """Every document against all gates at once: those it fails, the number of violations, and whether it passes."""
    rows = v.documents.select("doc_id", F.lit(None).cast("string").alias("gate"))
    for name, gate in GATES.items():
        rows = rows.unionByName(gate(v).select("doc_id", F.lit(name).alias("gate")))
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("gate")).alias("found"), F.count("gate").alias("violations"))
    return g.select("doc_id", F.when(F.size("found") > 0, F.col("found")).alias("gates"), "violations", (F.col("violations") == 0).alias("passed"))


@operator("Q35", "SELECT s.doc_id, round(o.n / CAST(s.n AS DOUBLE), 6) AS ratio FROM (SELECT doc_id, max(line_no) // 3 + 1 AS n FROM st GROUP BY doc_id) s JOIN (SELECT doc_id - 1 AS doc_id, max(line_no) // 3 + 1 AS n FROM st GROUP BY doc_id) o ON o.doc_id = s.doc_id WHERE s.n >= 5 AND NOT o.n / CAST(s.n AS DOUBLE) BETWEEN 0.7 AND 0.85")
def page_budget(v):
    """Documents of five pages or more whose output (the paired document) has under 70 or over 85 % as many; a page is three lines here."""
    n = v.st.groupBy("doc_id").agg((F.floor(F.max("line_no") / 3) + 1).alias("n"))
    o = n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("out"))
    ratio = F.col("out") / F.col("n").cast("double")
    return n.where("n >= 5").join(o, "doc_id").where(~ratio.between(0.7, 0.85)).select("doc_id", F.round(ratio, 6).alias("ratio"))


@operator("Q46 Y5", """SELECT c.doc_id, c.page, c.line_no, count(f.did) AS figures FROM (SELECT s.doc_id, s.page, s.line_no, s.y0 FROM st s WHERE regexp_matches(text, '^(?:Figure|Table|图|表)\\s*[0-9]+[-.][0-9]+')) c LEFT JOIN dw f ON f.doc_id = c.doc_id AND f.page = c.page AND f.fill = 'art' AND c.y0 - f.y1 BETWEEN -20 AND 200 GROUP BY ALL HAVING count(f.did) <> 1""")
def figures_per_caption(v):
    """Captions with no figure, or with more than one, within 200 points above or 20 into them."""
    c = captions(v).select("doc_id", "line_no").join(v.st.select("doc_id", "page", "line_no", "y0"), ["doc_id", "line_no"])
    f = v.dw.where("fill = 'art'").select(F.col("doc_id").alias("fd"), F.col("page").alias("fp"), "did", F.col("y1").alias("fy1"))
    j = c.join(f, F.expr("doc_id = fd AND page = fp AND y0 - fy1 BETWEEN -20 AND 200"), "left")
    return j.groupBy("doc_id", "page", "line_no").agg(F.count("did").alias("figures")).where("figures <> 1")


@operator("Q05 E3", r"SELECT p_partkey, p_name, CASE WHEN out IS NULL THEN 'none' ELSE 'same' END AS fault FROM (SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, '^\S+ \S+') THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS out FROM part) WHERE out IS NULL OR out = p_name")
def rule_misses(v):
    """Descriptions for which the rule (the two leading words exchanged) gives nothing, or the text itself."""
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    out = F.when(F.col("p_name").rlike(r"^\S+ \S+"), F.concat(word(2), F.lit(" "), word(1)))
    return v.part.select("p_partkey", "p_name", out.alias("out")).where("out IS NULL OR out = p_name").select("p_partkey", "p_name", F.when(F.col("out").isNull(), "none").otherwise("same").alias("fault"))


@operator("Q21 W11 W1", """SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS role_before, role FROM conversations) WHERE before IS NOT NULL AND (turn <> before + 1 OR role = role_before)""")
def span_breaks(v):
    """Spans that don't follow the one before by one, or repeat its kind."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = v.conversations.select("conv_id", "turn", "role", F.lag("turn").over(w).alias("before"), F.lag("role").over(w).alias("role_before"))
    return c.where("before IS NOT NULL AND (turn <> before + 1 OR role = role_before)").select("conv_id", "turn")
