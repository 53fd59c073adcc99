"""Rules of the layout handbook as queries, and bounded iterations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.plans.registry import operator


@operator("Y2", """SELECT page_key, row_key, isle, string_agg(CAST(size AS VARCHAR), '' ORDER BY x0, rid) AS value FROM (SELECT *, sum(new) OVER (PARTITION BY page_key, row_key ORDER BY x0, rid) AS isle FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_key, row_key ORDER BY x0, rid) < 2.8 THEN 0 ELSE 1 END AS new FROM (SELECT *, CAST(floor(y0 / 100) AS BIGINT) AS row_key FROM rc))) GROUP BY page_key, row_key, isle""", big="isle")
def digit_fragments(v):
    """Digit fragments re-joined where the gap is under 2.8 points."""
    w = Window.partitionBy("page_key", "row_key").orderBy("x0", "rid")
    r = v.rc.withColumn("row_key", F.floor(F.col("y0") / 100))
    r = r.withColumn("new", F.when(F.col("x0") - F.lag("x1").over(w) < 2.8, 0).otherwise(1)).withColumn("isle", F.sum("new").over(w))
    g = r.groupBy("page_key", "row_key", "isle").agg(F.array_sort(F.collect_list(F.struct("x0", "rid", "size"))).alias("s"))
    return g.select("page_key", "row_key", "isle", F.array_join(F.transform("s", lambda x: x["size"].cast("string")), "").alias("value"))


@operator("Y4 Y6", """SELECT c.page_key, c.rid, arg_min(f.rid, abs(c.y0 - f.y1) * 1000 + f.rid) AS figure FROM rc c LEFT JOIN rc f ON c.page_key = f.page_key AND f.rid <> c.rid AND f.size >= 9 AND c.y0 - f.y1 > -20 AND c.y0 - f.y1 < 200 WHERE c.size = 6 GROUP BY c.page_key, c.rid""")
def caption_figures(v):
    """Captions with the nearest figure from 20 points below to 200 above; null where there is none."""
    c = v.rc.where("size = 6").select("page_key", "rid", "y0")
    f = v.rc.where("size >= 9").select(F.col("page_key").alias("pk"), F.col("rid").alias("frid"), F.col("y1").alias("fy1"))
    d = F.col("y0") - F.col("fy1")
    return c.join(f, (c.page_key == f.pk) & (F.col("frid") != F.col("rid")) & (d > -20) & (d < 200), "left").groupBy("page_key", "rid").agg(F.min_by("frid", F.struct(F.abs(d), "frid")).alias("figure"))


@operator("Y7", """SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(text, '^[A-Z][a-z]+\\.$') THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM ln""", big="line_no")
def section_of_lines(v):
    """The last heading at or above each line, as of its place."""
    head = F.when(F.col("text").rlike(r"^[A-Z][a-z]+\.$"), F.col("text"))
    return v.ln.select("doc_id", "line_no", F.last(head, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no")).alias("section"))


@operator("Y8 Y14", """SELECT text, count(DISTINCT value) AS values, min(value) AS value FROM (SELECT un.text, d.value FROM un JOIN dk d ON d.key = un.text AND d.value IS NOT NULL) GROUP BY text HAVING count(DISTINCT value) > 1""")
def term_conflicts(v):
    """Terms that the dictionary's batches translate differently."""
    d = v.dk.where("value IS NOT NULL").select(F.col("key").alias("text"), "value")
    return v.un.select("text").distinct().join(d, "text").groupBy("text").agg(F.countDistinct("value").alias("values"), F.min("value").alias("value")).where("values > 1")


@operator("Y15", "SELECT xref, place_no FROM img WHERE w < width_pt * 4")
def narrow_figures(v):
    """Figures narrower than their source at four times the point width."""
    return v.img.where("w < width_pt * 4").select("xref", "place_no")


@operator("Y8 J1", """SELECT page, unit_no, coalesce(d.value, text) AS text FROM un LEFT JOIN (SELECT key, arg_min(value, batch) AS value FROM dk WHERE value IS NOT NULL AND value <> '' GROUP BY key) d ON d.key = un.text""")
def unified_terms(v):
    """Units with the first value that isn't empty, else as they are."""
    d = v.dk.where("value IS NOT NULL AND value <> ''").groupBy(F.col("key").alias("text")).agg(F.min_by("value", "batch").alias("value"))
    return v.un.join(d, "text", "left").select("page", "unit_no", F.coalesce("value", "text").alias("text"))


@operator("E9 E10", """SELECT doc_id, page, unit_no, text FROM un WHERE NOT regexp_matches(text, '^D-') AND page % 5 = doc_id % 5 AND x1 - x0 > 40""")
def parameterised_units(v):
    """Units under parameters: a white-list pattern, a page rule and a width."""
    keep, width = "^D-", 40
    return v.un.where(~F.col("text").rlike(keep) & (F.col("page") % 5 == F.col("doc_id") % 5) & (F.col("x1") - F.col("x0") > width)).select("doc_id", "page", "unit_no", "text")


@operator("D18", """SELECT stem, count(*) AS keys, count(value) AS set_values, count(*) FILTER (WHERE value = ' ') AS erased FROM dk GROUP BY stem""")
def registry_summary(v):
    """What a dictionary registry holds: keys, set values and erasures."""
    return v.dk.groupBy("stem").agg(F.count(F.lit(1)).alias("keys"), F.count("value").alias("set_values"), F.count_if(F.col("value") == " ").alias("erased"))
