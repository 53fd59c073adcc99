"""Layout solvers and judgement requests: bounded searches a page at a time, retries and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions.text import count_lines_udf, em
from foliomill.plans.registry import operator

#: Scales and gaps of the first-fit ladder, in order of preference.
SCALES, GAPS = (1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7), (8, 6, 4, 2, 0)


@operator("O10 X13 W15", """SELECT page_key, coalesce(min(k) FILTER (WHERE ok), 34) AS step FROM (SELECT page_key, (s.i - 1) * 5 + (g.i - 1) AS k, total * s.v + g.v * (n - 1) <= 40 AS ok FROM (SELECT page_key, sum(y1 - y0) AS total, count(*) AS n FROM rc GROUP BY page_key), (SELECT unnest([1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7]::DOUBLE[]) AS v, generate_subscripts([1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7], 1) AS i) s, (SELECT unnest([8, 6, 4, 2, 0]) AS v, generate_subscripts([8, 6, 4, 2, 0], 1) AS i) g) GROUP BY page_key""", big="step")
def flow_ladder(v):
    """The first of 35 steps of scale and gap at which a page's units fit in 40 points, else the last."""
    p = v.rc.groupBy("page_key").agg(F.sum(F.col("y1") - F.col("y0")).alias("total"), F.count(F.lit(1)).alias("n"))
    fits = [F.when(F.col("total") * s + g * (F.col("n") - 1) <= 40, len(GAPS) * i + j) for i, s in enumerate(SCALES) for j, g in enumerate(GAPS)]
    return p.select("page_key", F.coalesce(*fits, F.lit(len(fits) - 1)).alias("step"))


@operator("T18")
def block_layout(v):
    """Text blocks of a page wrapped into its width one under the other: first and last line and height of each.

    Only the lines of a text are counted in Python; heights are added up in order, a page at a time. A missing text has no lines.
    """
    limit = F.greatest(F.lit(4.0), (F.col("x1") - F.col("x0")) / F.col("size"))
    u = v.un.select("page", F.col("unit_no").cast("int").alias("unit_no"), "size", F.coalesce(count_lines_udf("text", limit), F.lit(0)).alias("lines"))
    p = u.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("unit_no", "size", "lines"))).alias("units"))
    row = "array<struct<unit_no:int,top:double,lines:int,bottom:double>>"

    def under(acc, x):
        bottom = acc["y"] + F.lit(1.2) * x["size"] * x["lines"]
        return F.struct((bottom + 4).alias("y"), F.concat(acc["rows"], F.array(F.struct(x["unit_no"].alias("unit_no"), acc["y"].alias("top"), x["lines"].alias("lines"), bottom.alias("bottom")))).alias("rows"))

    laid = F.aggregate("units", F.struct(F.lit(72.0).alias("y"), F.array().cast(row).alias("rows")), under, lambda acc: acc["rows"])
    return p.select("page", F.inline(laid))


@operator("T20", """SELECT page_id, ord, title || ' ' || repeat('.', CAST(greatest(3, 60 - length(title) - length(CAST(start AS VARCHAR))) AS INTEGER)) || ' ' || start AS line FROM (SELECT page_id, ord, title, 1 + CAST(ceil(n / 10.0) AS BIGINT) + ord // 3 AS start FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM toc))""", big="ord")
def two_pass_contents(v):
    """Contents lines with leaders: page numbers shift by the pages that the contents themselves take."""
    n = v.toc.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    start = (1 + F.ceil(F.col("n") / F.lit(10.0)) + F.floor(F.col("ord") / 3)).cast("long").cast("string")
    dots = F.repeat(F.lit("."), F.greatest(F.lit(3), 60 - F.length("title") - F.length(start)))
    return v.toc.join(n, "page_id").select("page_id", "ord", F.concat_ws(" ", "title", dots, start).alias("line"))


@operator("A22", r"""SELECT page, unit_no, CASE WHEN kind % 2 = 0 THEN 'label' ELSE 'value' END AS part, round((0.55::DOUBLE * length(regexp_replace(text, '[^\x{0}-\x{2E80}]', '', 'g')) + 1.0::DOUBLE * length(regexp_replace(text, '[\x{0}-\x{2E80}]', '', 'g'))) * size, 4) AS width, 72 + 14 * unit_no AS y FROM un""", big="y")
def form_blocks(v):
    """Labels and values of a page as stacked form rows with their estimated widths."""
    wide = F.length(F.regexp_replace("text", r"[\x{0}-\x{2E80}]", ""))
    width = em("a") * (F.length("text") - wide) + em("表") * wide
    return v.un.select("page", "unit_no", F.when(F.col("kind") % 2 == 0, "label").otherwise("value").alias("part"), F.round(width * F.col("size"), 4).alias("width"), (72 + 14 * F.col("unit_no")).alias("y"))



@operator("DT1 DT2", """SELECT user_id, count(*) AS reads, count(*) FILTER (WHERE gap > 1800) AS stale, count(*) FILTER (WHERE gap > 86400 OR gap IS NULL) AS refetched FROM (SELECT user_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id""")
def cache_ages(v):
    """Reads of each cache entry: locks stale after half an hour, contents after a day."""
    from pyspark.sql import Window

    t = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long")  # to the nearest second, halves to even
    gap = t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.events.select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("gap") > 1800).alias("stale"), F.count_if((F.col("gap") > 86400) | F.col("gap").isNull()).alias("refetched"))


@operator("E6 V9", "SELECT geo_id, CASE WHEN dark >= 12 THEN 'rule' ELSE 'locator' END AS method, CASE WHEN dark >= 12 THEN dark / 72.0::DOUBLE ELSE (255 - low) / 255.0::DOUBLE END AS score FROM (SELECT geo_id, count(*) FILTER (WHERE v < 60) AS dark, min(v) AS low FROM ring GROUP BY geo_id)")
def last_resort_locator(v):
    """Rings located by rule where there are dark samples enough; only the rest goes to the slow locator."""
    g = v.ring.groupBy("geo_id").agg(F.count_if(F.col("v") < 60).alias("dark"), F.min("v").alias("low"))

    def locate(batches):
        for b in batches:
            yield b.assign(method="locator", score=[float(255 - x) / 255 for x in b["low"]])[["geo_id", "method", "score"]]

    sure = g.where("dark >= 12").select("geo_id", F.lit("rule").alias("method"), (F.col("dark") / 72).alias("score"))
    return sure.unionByName(g.where("dark < 12").mapInPandas(locate, "geo_id long, method string, score double"))



@operator("K10", """SELECT page_key, string_agg(txt, '|' ORDER BY rid) AS buffer, md5(string_agg(txt, '|' ORDER BY rid)) AS digest FROM rc GROUP BY page_key""")
def page_buffers(v):
    """Each page as one buffer with its digest, ready to be packed."""
    b = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rid", "txt"))), lambda x: x["txt"]), "|")
    return v.rc.groupBy("page_key").agg(b.alias("buffer")).withColumn("digest", F.md5("buffer"))
