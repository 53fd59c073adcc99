"""Queries on rows that the smallest tables lack, and what passes between Spark and Python."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from foliomill.functions import raster
from foliomill.functions.text import wrap
from foliomill.plans.catalog import ORACLES, QUERIES
from foliomill.sources.views import Views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["densities", "erased_labels", "tight_boxes", "detected_text", "ink_outside_margins"])
def test_no_pixels_between_spark_and_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "pixels" not in plan


def test_erasures_are_those_of_the_whole_image():
    r = np.random.default_rng(2)
    for n in (1, 3, 12, 40):
        boxes = [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(r.integers(0, 150, n), r.integers(0, 90, n), r.integers(5, 60, n), r.integers(5, 14, n))]
        im = raster.draw(boxes[: n // 2 + 1], 200, 100)
        out = [(raster.erase(im, b), b) for b in boxes]
        assert raster.erasures(im, boxes) == [(int(raster.ink(o)[b[1] : b[3], b[0] : b[2]].sum()), len(raster.text_boxes(im)) - len(raster.text_boxes(o))) for o, b in out]


def test_paper_is_the_median():
    r = np.random.default_rng(3)
    for values in ([30, 255], [30, 130, 255], [200, 255], [30], [128, 140, 255, 255]):
        im = r.choice(np.array(values, dtype=np.uint8), (9, 14))
        light = im[im >= 128]
        assert raster.paper(im) == (int(np.median(light)) if light.size else 255)


def same_as_sql(spark, folder, table, rows, name):
    """Whether a query over one written table gives its SQL's rows."""
    duck = duckdb.connect()
    duck.register("given", rows)
    duck.execute(f"COPY (SELECT * FROM given) TO '{folder}/{table}.parquet'")
    duck.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    got, want = QUERIES[name](spark, str(folder)).select(cols).collect(), cur.fetchall()
    return sorted(map(tuple, got)) == sorted(want) and len(want) > 0


def test_widths_at_whole_lines(spark, tmp_path):
    """Lines whose width is a whole number of 160 points."""
    texts = ["\n".join("x" * n + "表" * m for n in range(0, 1000, 20)) for m in range(24)]
    rows = pd.DataFrame({"doc_id": range(24), "text": texts, "lang": "en", "source": "a", "n_chars": [len(t) for t in texts]})
    assert same_as_sql(spark, tmp_path, "documents", rows, "line_widths")


def test_gaps_between_fractions_of_seconds(spark, tmp_path):
    at = [0.4, 1800.6, 3601.0, 90001.5, 176401.4, 262801.9, 262802.5, 264603.5]
    ts = [pd.Timestamp("2024-01-01") + pd.Timedelta(microseconds=round(x * 1e6)) for x in at]
    rows = pd.DataFrame({"event_id": range(16), "ts": ts + [t + pd.Timedelta(milliseconds=700) for t in ts[::-1]], "user_id": [1] * 8 + [2] * 8, "event_type": "view", "value": 1.0, "props": "{}"})
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    assert same_as_sql(spark, tmp_path, "events", rows, "cache_ages")


def test_blocks_without_a_python_call_for_each_page(spark):
    """The rows of a fold in Python, from a plan that sends only texts there."""
    df = QUERIES["block_layout"](spark, SF)
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    want, last, y = [], None, 0.0
    for r in Views(spark, SF).un.orderBy("page", "unit_no").collect():
        y = y if r["page"] == last else 72.0
        n = len(wrap(r["text"], max(4.0, (r["x1"] - r["x0"]) / r["size"])))
        want.append((r["page"], r["unit_no"], y, n, y + 1.2 * r["size"] * n))
        last, y = r["page"], want[-1][-1] + 4
    assert sorted(map(tuple, df.collect())) == want
