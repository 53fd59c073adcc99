"""Pages as an extraction yields them: styled lines, drawings, image placements and contents entries.

The stored documents hold plain lines only. These relations give every line of a document a form in turn (caption, leader row, slot, mark ...)
around its own first word, so that each operator meets rows that pass and rows that don't. As in views.py each exists as a DataFrame and
as DuckDB text; the expressions are shared where both engines read them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Forms of lines, lines of a page, and their pitch and height.
FORMS, SHEET_LINES, PITCH, HEIGHT = 32, 20, 12, 10
_K, _N = f"((doc_id * 5 + line_no) % {FORMS})", "CAST(line_no + 1 AS STRING)"
_D = "CAST(doc_id % 9 + 1 AS STRING)"
_W = "CASE WHEN w = '' THEN 'item' ELSE w END"
#: The text of each form, as an expression over w (a line's first word), text, doc_id and line_no.
TEXTS = {
    0: f"concat('Figure ', {_D}, '-', {_N}, ' ', {_W})",
    1: f"concat({_W}, ' ......', ' ', CAST(line_no + 3 AS STRING))",
    2: f"concat({_D}, '-', {_N}, ' | P a g e')",
    3: f"concat('表 ', {_W}, ', 时间 9:52; 值 1,500! (完)')",
    4: f"concat({_W}, ' **', lower({_W}), '** end')",
    5: f"concat({_W}, ' A\u2011200\u00ad x\u00a0y')",
    6: f"concat('UNLESS OTHERWISE NOTED ', {_W})",
    7: f"concat({_N}, '.', CAST(doc_id % 4 AS STRING), '.0 ', {_W})",
    8: f"concat('图 ', {_N}, '-1 ', {_W})",
    9: f"concat('\uf061 = 3\uf0b0 ', {_W}, ' \uf0b7 \ue123')",
    10: "concat('(', CAST(line_no % 99 AS STRING), ')')",
    11: f"concat('API ', {_N}, '.5 psi')",
    12: f"concat({_W}, ' ', {_W}, ' done')",
    13: f"concat({_W}, ' ...')",
    14: f"concat('... ', {_N})",
    15: f"concat({_W}, ' and the value of the')",
    16: "'continues here without an end'",
    17: f"concat('1. ', {_W}, ' is listed')",
    18: "'hanging below its number'",
    19: "'Name:'",
    20: "'____ ____ ____ ____ ____ ____ ____ ____'",
    21: f"concat('DRAFT ', {_W})",
    22: f"concat('turned ', {_W})",
    23: f"concat('• ', {_W}, ' point')",
    24: f"concat('FIN ', CAST(60 + line_no % 5 AS STRING), ' ANG 30 ', {_W})",
    27: f"concat({_W}, '    ', {_W}, ' far tail')",
    25: f"concat('Table ', {_D}, '.', {_N}, ' ', {_W})",
}
STYLE = {
    "size": "CAST(CASE k WHEN 0 THEN 8 WHEN 6 THEN 6 WHEN 7 THEN 14 WHEN 21 THEN 40 WHEN 24 THEN 5 WHEN 25 THEN 8 ELSE CASE WHEN doc_id % 3 = 0 THEN 9.5 WHEN doc_id % 8 = 4 THEN 18 ELSE 10 END END AS DOUBLE)",
    "bold": "k IN (7, 19)",
    "color": "CAST(CASE WHEN k IN (4, 12) THEN 16711680 ELSE 13158 END AS INT)",
    "font": "CASE WHEN k = 21 THEN 'Arial-WM' WHEN k = 7 THEN 'Times-Bold' ELSE 'Times' END",
    "dx": "CAST(CASE WHEN k = 22 THEN 0 WHEN k = 29 AND doc_id % 4 = 0 THEN -1 ELSE 1 END AS DOUBLE)",
    "dy": "CAST(CASE WHEN k = 22 THEN CASE WHEN doc_id % 2 = 0 THEN -1 ELSE 1 END WHEN k = 23 THEN 0.1 ELSE 0 END AS DOUBLE)",
    "x0": "CAST(CASE WHEN k IN (18, 23) THEN 72 WHEN k = 10 THEN 300 ELSE 54 END AS DOUBLE)",
}
#: Drawings that go with lines of some forms: form, kind of item, box relative to the line, fill.
DRAWN = [
    (0, "re", 54, -9, 260, 1, "art"),
    (3, "re", 50, -2, 540, 14, "none"),
    *[(10, "re", 200 + 16 * i, 1, 208 + 16 * i, 9 + i % 3, "none") for i in range(18)],
    (11, "re", 54, 9.8, 200, 10.2, "black"),
    (20, "l", 100, 10, 260, 10, "black"),
    (26, "l", 96, 10, 180, 10.3, "black"),
    (28, "re", 0, -60, 612, 300, "white"),
    (30, "re", 590, 0, 592, 30, "black"),
    (31, "re", 60, -80, 560, 200, "none"),
]


#: The top of a line: a gap after each block of five lines, wider in every other document.
TOP = f"CAST(72 + {PITCH} * (line_no % {SHEET_LINES}) + floor(line_no % {SHEET_LINES} / 5) * CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 3 END AS DOUBLE)"


def case_texts() -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {t}" for k, t in TEXTS.items()) + " ELSE text END"


def duck(sql: str) -> str:
    return sql.replace("AS STRING)", "AS VARCHAR)").replace("AS INT)", "AS INTEGER)")


class Sheets:
    """Mixed into the views: st, sw, pg, dw, pl and te."""

    @property
    def st(self) -> DataFrame:
        """Styled lines: doc_id, line_no, page, k (form), text, style, direction and box."""
        lines = self.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
        lines = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", F.regexp_extract("text", "[A-Za-z]+", 0).alias("w"), F.expr(_K).cast("int").alias("k"))
        formed = lines.select("doc_id", "line_no", F.floor(F.col("line_no") / SHEET_LINES + 1).cast("long").alias("page"), "k", F.expr(case_texts()).alias("text"), *[F.expr(e).alias(c) for c, e in STYLE.items()])
        y0 = F.expr(TOP)
        return formed.select("*", y0.alias("y0"), (F.col("x0") + 6 * F.length("text")).alias("x1"), (y0 + HEIGHT).alias("y1"))

    @property
    def sw(self) -> DataFrame:
        """Words of styled lines, six points a character."""
        w = self.st.select("doc_id", "page", "line_no", "size", "x0", "y0", "y1", F.posexplode(F.split("text", " ", -1)).alias("word_no", "w"))
        before = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
        w = w.withColumn("c0", F.coalesce(F.sum(F.length("w") + 1).over(before), F.lit(0))).where("w <> ''")
        left = F.col("x0") + 6 * F.col("c0")
        return w.select("doc_id", "page", "line_no", F.col("word_no").cast("long").alias("word_no"), "size", "w", left.alias("x0"), "y0", (left + 6 * F.length("w")).alias("x1"), "y1")

    @property
    def pg(self) -> DataFrame:
        """Pages with their size and rotation; every fourth document lies across."""
        across, r = F.col("doc_id") % 4 == 0, F.col("doc_id") % 16
        return self.st.select("doc_id", "page").distinct().select("doc_id", "page", F.when(across, 792.0).otherwise(612.0).alias("w"), F.when(across, 612.0).otherwise(792.0).alias("h"), F.when(r == 1, 90).when(r == 2, 180).when(r == 3, 270).otherwise(0).cast("long").alias("rot"))

    @property
    def dw(self) -> DataFrame:
        """Drawings of pages: doc_id, page, did, item, box, fill."""
        rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("dk"), F.lit(item).alias("item"), *[F.lit(float(x)).alias(c) for c, x in zip(("ax0", "ay0", "ax1", "ay1"), box)], F.lit(fill).alias("fill")) for i, (k, item, *box, fill) in enumerate(DRAWN)])
        d = self.st.where(F.col("k").isin(*{r[0] for r in DRAWN})).select("doc_id", "page", "line_no", "k", "y0", F.explode(rows).alias("r")).where("k = r.dk")
        return d.select("doc_id", "page", (F.col("line_no") * 64 + F.col("r.i")).alias("did"), "r.item", F.col("r.ax0").alias("x0"), (F.col("y0") + F.col("r.ay0")).alias("y0"), F.col("r.ax1").alias("x1"), (F.col("y0") + F.col("r.ay1")).alias("y1"), "r.fill")

    @property
    def pl(self) -> DataFrame:
        """Images placed on pages: one on every third page, larger on every fifth document; width and rotation of those pages."""
        p = self.st.groupBy("doc_id", "page").agg(F.min("line_no").alias("line_no"))
        big = F.col("doc_id") % 5 == 0
        return p.where("(doc_id + page) % 3 = 0").select("doc_id", "page", F.lit(40.0).alias("x0"), F.lit(60.0).alias("y0"), F.when(big, 580.0).otherwise(200.0).alias("x1"), F.when(big, 700.0).otherwise(160.0).alias("y1"))

    @property
    def te(self) -> DataFrame:
        """Contents entries: anchors with a number, a printed page and the page they lead to."""
        n = F.concat_ws(".", (F.col("page_id") % 7 + 1).cast("string"), (F.col("ord") % 3).cast("string"), F.when(F.col("ord") % 2 == 0, "0"))
        kind = F.col("ord") % 4
        title = F.when(kind == 3, F.concat(F.lit("图 "), (F.col("ord") + 1).cast("string"), F.lit(" "), "title")).when(kind == 2, F.col("title")).otherwise(F.concat(n, F.lit(" "), "title"))
        goal = (F.col("page_id") + F.col("ord") % 2).cast("string")
        return self.toc.select("page_id", F.col("ord").cast("long").alias("ord"), title.alias("title"), goal.alias("printed"), "target")


VIEW_SQL = {
    "st": duck(
        f"SELECT *, x0 + 6 * length(text) AS x1, y0 + {HEIGHT} AS y1 FROM (SELECT *, {TOP} AS y0 FROM (SELECT doc_id, line_no, line_no // {SHEET_LINES} + 1 AS page, k, {case_texts()} AS text, {', '.join(f'{e} AS {c}' for c, e in STYLE.items())} "
        f"FROM (SELECT *, regexp_extract(text, '[A-Za-z]+') AS w, CAST({_K} AS INT) AS k FROM (SELECT doc_id, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))))"
    ),
    "sw": "SELECT doc_id, page, line_no, word_no, size, w, x0 + 6 * c0 AS x0, y0, x0 + 6 * (c0 + length(w)) AS x1, y1 FROM (SELECT *, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c0 FROM (SELECT doc_id, page, line_no, size, x0, y0, y1, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS word_no FROM (SELECT *, string_split(text, ' ') AS ws FROM st))) WHERE w <> ''",
    "pg": "SELECT DISTINCT doc_id, page, CASE WHEN doc_id % 4 = 0 THEN 792.0 ELSE 612.0 END::DOUBLE AS w, CASE WHEN doc_id % 4 = 0 THEN 612.0 ELSE 792.0 END::DOUBLE AS h, CAST(CASE WHEN doc_id % 16 = 1 THEN 90 WHEN doc_id % 16 = 2 THEN 180 WHEN doc_id % 16 = 3 THEN 270 ELSE 0 END AS BIGINT) AS rot FROM st",
    "dw": "SELECT doc_id, page, line_no * 64 + i AS did, item, ax0 AS x0, y0 + ay0 AS y0, ax1 AS x1, y0 + ay1 AS y1, fill FROM st JOIN (VALUES " + ", ".join(f"({i}, {k}, '{item}', {', '.join(f'{float(x)}::DOUBLE' for x in box)}, '{fill}')" for i, (k, item, *box, fill) in enumerate(DRAWN)) + ") r(i, dk, item, ax0, ay0, ax1, ay1, fill) ON k = dk",
    "pl": "SELECT doc_id, page, 40.0::DOUBLE AS x0, 60.0::DOUBLE AS y0, CASE WHEN doc_id % 5 = 0 THEN 580.0 ELSE 200.0 END::DOUBLE AS x1, CASE WHEN doc_id % 5 = 0 THEN 700.0 ELSE 160.0 END::DOUBLE AS y1 FROM (SELECT DISTINCT doc_id, page FROM st) WHERE (doc_id + page) % 3 = 0",
    "te": "SELECT page_id, CAST(ord AS BIGINT) AS ord, CASE ord % 4 WHEN 3 THEN '图 ' || (ord + 1) || ' ' || title WHEN 2 THEN title ELSE concat_ws('.', CAST(page_id % 7 + 1 AS VARCHAR), CAST(ord % 3 AS VARCHAR), CASE WHEN ord % 2 = 0 THEN '0' END) || ' ' || title END AS title, CAST(page_id + ord % 2 AS VARCHAR) AS printed, target FROM toc",
}
