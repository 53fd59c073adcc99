"""Order-sensitive operators: previous and next rows, runs, shared maxima."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.operators.aggregates import upper_median
from foliomill.plans.registry import operator


@operator("W1 T30 Q18", """SELECT doc_id, line_no, joined FROM (SELECT doc_id, line_no, lower(regexp_extract(lag(text) OVER (PARTITION BY doc_id ORDER BY line_no), '([A-Za-z]+)\\W*$', 1) || regexp_extract(text, '^([A-Za-z]+)', 1)) AS joined, length(regexp_extract(text, '^([A-Za-z]+)', 1)) AS n FROM ln) WHERE n > 0 AND joined IN (SELECT lower(regexp_extract(w, '^([A-Za-z]+)', 1)) FROM wd WHERE length(w) > 5)""")
def word_splits(v):
    """Line breaks where the last word before and the first after make a word of the vocabulary."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("line_no"))
    head = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    j = v.ln.select("doc_id", "line_no", F.lower(F.concat(F.regexp_extract(before, r"([A-Za-z]+)\W*$", 1), head)).alias("joined"), F.length(head).alias("n")).where("n > 0").drop("n")
    vocab = v.wd.where(F.length("w") > 5).select(F.lower(F.regexp_extract("w", "^([A-Za-z]+)", 1)).alias("joined")).distinct()
    return j.join(vocab, "joined", "left_semi").select("doc_id", "line_no", "joined")


@operator("W4 A13", """SELECT page_key, coalesce(list_sort(list(gap))[len(list(gap)) // 2 + 1], 8.0) AS gap FROM (SELECT page_key, CASE WHEN g >= 0 AND g < 60 THEN g END AS gap FROM (SELECT page_key, lead(y0) OVER (PARTITION BY page_key ORDER BY y0, rid) - y1 AS g FROM rc)) WHERE gap IS NOT NULL GROUP BY page_key
  UNION ALL SELECT DISTINCT page_key, 8.0 FROM rc WHERE page_key NOT IN (SELECT page_key FROM (SELECT page_key, lead(y0) OVER (PARTITION BY page_key ORDER BY y0, rid) - y1 AS g FROM rc) WHERE g >= 0 AND g < 60)""")
def upper_median_gap(v):
    """The upper median of gaps from 0 to 60 between neighbours, else 8."""
    g = F.lead("y0").over(Window.partitionBy("page_key").orderBy("y0", "rid")) - F.col("y1")
    return v.rc.select("page_key", g.alias("g")).select("page_key", F.when((F.col("g") >= 0) & (F.col("g") < 60), F.col("g")).alias("gap")).groupBy("page_key").agg(F.coalesce(upper_median("gap"), F.lit(8.0)).alias("gap"))


@operator("W9", """SELECT page_key, y1, cols, sum(new) OVER (PARTITION BY page_key ORDER BY y1) AS part FROM (SELECT *, CASE WHEN lag(cols) OVER (PARTITION BY page_key ORDER BY y1) IS DISTINCT FROM cols THEN 1 ELSE 0 END AS new FROM (SELECT page_key, y1, list(x0 ORDER BY x0, rid) AS cols FROM rc GROUP BY page_key, y1))""", big="part")
def sub_tables(v):
    """Rows of a table with the number of their part: a new one begins wherever the columns' left edges change."""
    rows = v.rc.groupBy("page_key", "y1").agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "rid"))), lambda x: x["x0"]).alias("cols"))
    o = Window.partitionBy("page_key").orderBy("y1")
    new = F.when(F.lag("cols").over(o).eqNullSafe(F.col("cols")), 0).otherwise(1)
    return rows.withColumn("new", new).select("page_key", "y1", "cols", F.sum("new").over(o).alias("part"))


@operator("W8", """SELECT page_key, rid, sum(new) OVER (PARTITION BY page_key ORDER BY rid) AS table_no, new = 1 AS header FROM (SELECT *, CASE WHEN lag(size) OVER (PARTITION BY page_key ORDER BY rid) IS DISTINCT FROM size OR txt = first_value(txt) OVER (PARTITION BY page_key ORDER BY rid) THEN 1 ELSE 0 END AS new FROM rc)""", big="table_no")
def table_headers(v):
    """A row is a header if its signature differs from the row before or its first cell is the page's first one again."""
    w = Window.partitionBy("page_key").orderBy("rid")
    new = (~F.lag("size").over(w).eqNullSafe(F.col("size"))) | (F.col("txt") == F.first("txt").over(w))
    r = v.rc.withColumn("header", new)
    return r.select("page_key", "rid", F.sum(F.col("header").cast("int")).over(w).alias("table_no"), "header")


@operator("W10 C3", """SELECT page_key, CAST(len(list_reduce(sizes, lambda a, x: CASE WHEN len(a) = 0 OR x / a[-1] >= 1.4 OR a[-1] / x >= 1.4 THEN list_append(a, x) ELSE a END, CAST([] AS DOUBLE[]))) AS BIGINT) AS runs FROM (SELECT page_key, list(CAST(size AS DOUBLE) ORDER BY rid) AS sizes FROM rc GROUP BY page_key)""")
def size_runs(v):
    """Runs of units whose size stays within 1.4 times the run's first one, either way."""
    s = v.rc.groupBy("page_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rid", "size"))), lambda x: x["size"].cast("double")).alias("s"))
    fold = F.aggregate("s", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x / F.try_element_at(a, F.lit(-1)) >= 1.4) | (F.try_element_at(a, F.lit(-1)) / x >= 1.4), F.array_append(a, x)).otherwise(a))
    return s.select("page_key", F.size(fold).alias("runs"))


@operator("W12", "SELECT page_key, rid, CASE WHEN n > 1 AND l_linenumber % 2 = 0 THEN mx ELSE x1 END AS right_edge FROM (SELECT *, max(x1) FILTER (WHERE l_linenumber % 2 = 0) OVER (PARTITION BY page_key) AS mx, count(*) FILTER (WHERE l_linenumber % 2 = 0) OVER (PARTITION BY page_key) AS n FROM rc)")
def common_right(v):
    """Marked units share the largest right edge, if there is more than one."""
    w, mark = Window.partitionBy("page_key"), F.col("l_linenumber") % 2 == 0
    r = v.rc.withColumn("mx", F.max(F.when(mark, F.col("x1"))).over(w)).withColumn("n", F.count(F.when(mark, 1)).over(w))
    return r.select("page_key", "rid", F.when((F.col("n") > 1) & mark, F.col("mx")).otherwise(F.col("x1")).alias("right_edge"))


@operator("W13", """SELECT page_key, rid, least(size, mid) AS size FROM (SELECT * FROM rc WHERE l_linenumber <> 4) rc JOIN (SELECT page_key, k, list_sort(list(size))[len(list(size)) // 2 + 1] AS mid FROM (SELECT page_key, size, round_even((y0 + y1) / 8, 0) AS k FROM rc WHERE l_linenumber <> 4) GROUP BY page_key, k) m USING (page_key) WHERE m.k = round_even((y0 + y1) / 8, 0)""", big="size")
def row_font_sizes(v):
    """Sizes cut to the upper median of their row; rows are middles rounded to fours, turned texts (fourth lines) have none."""
    plain = v.rc.where("l_linenumber <> 4")
    k = F.bround((F.col("y0") + F.col("y1")) / 8, 0)
    m = plain.groupBy("page_key", k.alias("k")).agg(upper_median("size").alias("mid"))
    return plain.withColumn("k", k).join(m, ["page_key", "k"]).select("page_key", "rid", F.least("size", "mid").alias("size"))


@operator("W14", """SELECT page_key, rid, CASE WHEN count(*) OVER (PARTITION BY page_key, chain) >= 2 THEN min(x0) OVER (PARTITION BY page_key, chain) ELSE x0 END AS left_edge FROM (SELECT *, sum(new) OVER (PARTITION BY page_key ORDER BY y0, rid) AS chain FROM (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY page_key ORDER BY y0, rid) > 3 * (y1 - y0) THEN 1 ELSE 0 END AS new FROM rc))""")
def sibling_lefts(v):
    """The least left edge along vertical chains of two or more."""
    o = Window.partitionBy("page_key").orderBy("y0", "rid")
    new = F.when(F.col("y0") - F.lag("y1").over(o) > 3 * (F.col("y1") - F.col("y0")), 1).otherwise(0)
    r = v.rc.withColumn("new", new).withColumn("chain", F.sum("new").over(o))
    w = Window.partitionBy("page_key", "chain")
    return r.select("page_key", "rid", F.when(F.count(F.lit(1)).over(w) >= 2, F.min("x0").over(w)).otherwise(F.col("x0")).alias("left_edge"))


@operator("W16 C9", """SELECT page_key, c, count(*) AS members, max(y1) AS bottom FROM (SELECT *, sum(new) OVER (PARTITION BY page_key ORDER BY y0, rid) AS c FROM (SELECT *, CASE WHEN y0 > mx + 26 OR before = 10 THEN 1 ELSE 0 END AS new FROM (SELECT *, lag(size) OVER (PARTITION BY page_key ORDER BY y0, rid) AS before, max(y1) OVER (PARTITION BY page_key ORDER BY y0, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM rc))) GROUP BY page_key, c""", big="c")
def blocked_clusters(v):
    """Vertical clusters: one ends where the next rectangle lies over 26 points lower, or a text line (size 10) blocks it."""
    o = Window.partitionBy("page_key").orderBy("y0", "rid")
    lower = F.col("y0") > F.max("y1").over(o.rowsBetween(Window.unboundedPreceding, -1)) + 26
    r = v.rc.withColumn("new", F.when(lower | (F.lag("size").over(o) == 10), 1).otherwise(0)).withColumn("c", F.sum("new").over(o))
    return r.groupBy("page_key", "c").agg(F.count(F.lit(1)).alias("members"), F.max("y1").alias("bottom"))
