"""Layout relations derived from the stored tables: lines, words, rectangles, segments, dictionary, reading units and so on.

Each view exists twice: as a DataFrame (what the engine runs) and as DuckDB text (what checks it). Coordinates are integers or exact
fractions, so both engines agree to the bit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.sources import sheets

#: Lines on a page, line height, left margin and character width of the derived layout.
PAGE_LINES, LEADING, LEFT, CHAR = 50, 12, 54, 6


class Views(sheets.Sheets):
    """The stored tables (by name) and the derived relations of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ln(self) -> DataFrame:
        """Lines of documents, placed on pages."""
        d = self.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
        y = 72 + LEADING * (F.col("line_no") % PAGE_LINES)
        return d.select("doc_id", "line_no", "text", (F.floor(F.col("line_no") / PAGE_LINES) + 1).cast("int").alias("page"), F.lit(LEFT).alias("x0"), y.alias("y0"), (LEFT + CHAR * F.length("text")).alias("x1"), (y + LEADING).alias("y1"))

    @cached_property
    def wd(self) -> DataFrame:
        """Words of lines with the column they start in."""
        w = self.ln.select("doc_id", "line_no", "page", "y0", "y1", F.posexplode(F.split("text", " ", -1)).alias("word_no", "w"))
        before = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
        c0 = F.coalesce(F.sum(F.length("w") + 1).over(before), F.lit(0)).cast("int")
        w = w.withColumn("c0", c0).where("w <> ''")
        x0 = LEFT + CHAR * F.col("c0")
        return w.select("doc_id", "line_no", "page", "word_no", "w", "c0", x0.alias("x0"), "y0", (x0 + CHAR * F.length("w")).alias("x1"), "y1")

    @cached_property
    def rc(self) -> DataFrame:
        """Rectangles with a text and a size, on pages."""
        rid = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
        li = self.lineitem.join(self.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
        x0, y0 = F.col("l_partkey") % 300, F.col("l_suppkey") % 200
        return li.select(F.col("l_orderkey").alias("page_key"), rid.alias("rid"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 10 + 2 * F.col("l_quantity")).cast("double").alias("x1"), (y0 + 8 + F.col("l_linenumber") % 5).cast("double").alias("y1"), (6 + F.col("l_linenumber") % 5).cast("int").alias("size"), F.col("p_name").alias("txt"), "l_partkey", "l_linenumber", "l_quantity", "p_brand")

    @cached_property
    def sg(self) -> DataFrame:
        """Ruled segments: axis, position k, from a to b."""
        a = (F.col("l_partkey") % 300).cast("double")
        return self.lineitem.select(F.floor(F.col("l_orderkey") / 16).alias("page_key"), F.when(F.col("l_linenumber") % 2 == 0, "V").otherwise("H").alias("axis"), (F.col("l_suppkey") % 40).cast("int").alias("k"), a.alias("a"), (a + F.col("l_quantity")).alias("b")).distinct()

    @cached_property
    def dk(self) -> DataFrame:
        """Dictionary modules: within a batch the first part wins; null is a miss, '' keeps, ' ' erases."""
        first = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 3, F.upper("p_name")).orderBy("p_partkey"))
        d = self.part.withColumn("rn", first).where("rn = 1")
        value = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, "").when(F.col("p_size") % 5 == 2, " ").otherwise(F.col("p_type"))
        return d.select(F.lit("main").alias("stem"), (F.col("p_partkey") % 3).cast("int").alias("batch"), F.upper("p_name").alias("key"), value.alias("value"))

    @cached_property
    def un(self) -> DataFrame:
        """Reading units of pages."""
        r, k = self.rc, F.col("l_linenumber") % 4
        text = F.when(k == 0, F.upper("txt")).when(k == 1, F.upper("p_brand")).when(k == 2, F.concat(F.lit("D-"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/8")))
        return r.select((F.col("page_key") % 50).alias("doc_id"), F.col("page_key").alias("page"), F.col("rid").alias("unit_no"), text.alias("text"), "size", k.cast("int").alias("kind"), "x0", "y0", "x1", "y1")

    @cached_property
    def toc(self) -> DataFrame:
        """Anchors of pages in order, with title, target and the page's heading."""
        a = self.pages.select("page_id", F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1).alias("heading"), F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"[^>]*>'), 1).alias("h"), F.regexp_extract_all("html", F.lit(r'<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>'), 1).alias("t"))
        return a.select("page_id", "heading", F.posexplode(F.arrays_zip("h", "t")).alias("ord", "z")).select("page_id", "heading", "ord", F.col("z.t").alias("title"), F.col("z.h").alias("target"))

    @cached_property
    def jd(self) -> DataFrame:
        """Judgements on documents: a level with a confidence."""
        level = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "R").when(F.col("quality") == 1, "S").otherwise("blank")
        return self.labels.select("doc_id", level.alias("level"), ((F.col("doc_id") * 37 % 100) / 100.0).alias("conf"))

    @cached_property
    def img(self) -> DataFrame:
        """Placements of images."""
        n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_extendedprice"))
        return self.lineitem.select(F.col("l_suppkey").alias("xref"), n.alias("place_no"), (400 + F.col("l_suppkey") % 7 * 200).cast("int").alias("w"), (200 + F.col("l_suppkey") % 5 * 300).cast("int").alias("h"), F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 6).cast("double").alias("width_pt"))

    @cached_property
    def ring(self) -> DataFrame:
        """72 samples around each ring."""
        return self.part.select(F.col("p_partkey").alias("geo_id"), F.explode(F.sequence(F.lit(0), F.lit(355), F.lit(5))).alias("deg")).withColumn("v", ((F.col("geo_id") * 7 + F.floor(F.col("deg") / 25) * 91) % 256).cast("int"))


#: The same relations for DuckDB.
VIEW_SQL = {
    "ln": "SELECT doc_id, line_no, text, CAST(line_no // 50 + 1 AS BIGINT) AS page, 54 AS x0, 72 + 12 * (line_no % 50) AS y0, 54 + 6 * length(text) AS x1, 84 + 12 * (line_no % 50) AS y1 FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "wd": "SELECT doc_id, line_no, page, word_no, w, c0, 54 + 6 * c0 AS x0, y0, 54 + 6 * c0 + 6 * length(w) AS x1, y1 FROM (SELECT *, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS c0 FROM (SELECT doc_id, line_no, page, y0, y1, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS word_no FROM (SELECT *, string_split(text, ' ') AS ws FROM ln))) WHERE w <> ''",
    "rc": "SELECT l_orderkey AS page_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rid, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_suppkey % 200 AS DOUBLE) AS y0, CAST(l_partkey % 300 + 10 + 2 * l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 200 + 8 + l_linenumber % 5 AS DOUBLE) AS y1, 6 + l_linenumber % 5 AS size, p_name AS txt, l_partkey, l_linenumber, l_quantity, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey",
    "sg": "SELECT DISTINCT l_orderkey // 16 AS page_key, CASE WHEN l_linenumber % 2 = 0 THEN 'V' ELSE 'H' END AS axis, l_suppkey % 40 AS k, CAST(l_partkey % 300 AS DOUBLE) AS a, l_partkey % 300 + l_quantity AS b FROM lineitem",
    "dk": "SELECT 'main' AS stem, p_partkey % 3 AS batch, upper(p_name) AS key, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE p_type END AS value FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 3, upper(p_name) ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1",
    "un": "SELECT page_key % 50 AS doc_id, page_key AS page, rid AS unit_no, CASE l_linenumber % 4 WHEN 0 THEN upper(txt) WHEN 1 THEN upper(p_brand) WHEN 2 THEN 'D-' || l_partkey ELSE CAST(l_quantity AS INTEGER) || '/8' END AS text, size, l_linenumber % 4 AS kind, x0, y0, x1, y1 FROM rc",
    "toc": """SELECT page_id, heading, ord, t[ord + 1] AS title, h[ord + 1] AS target FROM (SELECT *, unnest(range(len(h))) AS ord FROM (SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading, regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1) AS h, regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1) AS t FROM pages))""",
    "jd": "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'R' WHEN quality = 1 THEN 'S' ELSE 'blank' END AS level, (doc_id * 37 % 100) / 100.0 AS conf FROM labels",
    "img": "SELECT l_suppkey AS xref, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_extendedprice) AS place_no, 400 + l_suppkey % 7 * 200 AS w, 200 + l_suppkey % 5 * 300 AS h, l_orderkey AS page, CAST(l_quantity * 6 AS DOUBLE) AS width_pt FROM lineitem",
    "ring": "SELECT p_partkey AS geo_id, deg, (p_partkey * 7 + deg // 25 * 91) % 256 AS v FROM part, (SELECT unnest(range(0, 360, 5)) AS deg)",
}
VIEW_SQL |= sheets.VIEW_SQL
