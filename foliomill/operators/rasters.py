"""Pixel operators: pages are drawn from their rectangles as binary images and measured, one page at a time.

A worker holds one page, as strips of equal rows where ink is all that is measured and as an image where cells and crops are; only
rectangles and results pass between Spark and Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import raster, strips
from foliomill.plans.registry import operator

WIDTH, HEIGHT = 420, 230
#: Rows of results that are handed on at once.
ROWS = 20_000


def rectangles(v) -> DataFrame:
    """page_key, rids, boxes (x0, y0, x1, y1 of each in turn) of every page."""
    own = v.rc.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("rid", "x0", "y0", "x1", "y1"))).alias("b"))
    return own.select("page_key", F.col("b.rid").alias("rids"), F.flatten(F.transform("b", lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"]))).alias("boxes"))


def image(boxes: np.ndarray) -> np.ndarray:
    return raster.draw(boxes.reshape(-1, 4).tolist(), WIDTH, HEIGHT)


def drawn(r) -> tuple[list[strips.Strip], list[list[float]]]:
    """A page's strips and its boxes."""
    boxes = r.boxes.reshape(-1, 4).tolist()
    return strips.draw(boxes, WIDTH, HEIGHT), boxes


def measure(pages: DataFrame, f, schema: str) -> DataFrame:
    """f(row) -> tuples, over all pages."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                rows += [(r.page_key, *x) for x in f(r)]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return pages.mapInPandas(run, schema)


@operator("Q06 Q07 Q44 D20")
def ink_outside_margins(v):
    """Ink pixels outside the margins and in the footer band of each page that has any."""

    def f(r):
        page, _ = drawn(r)
        yield strips.margin_ink(page, 10, 10, 400, 200), strips.ink_in(page, 0, 205, WIDTH, HEIGHT)

    return measure(rectangles(v), f, "page_key long, outside long, footer long").where("outside > 0 OR footer > 30")


@operator("V2 V8 V7")
def detected_text(v):
    """Boxes of text in the ink of each page, in reading order: connected parts of the ink, joined to words and then to lines."""
    return measure(rectangles(v), lambda r: [(k, *b) for k, b in enumerate(strips.detect(drawn(r)[0]))], "page_key long, box int, x0 int, y0 int, x1 int, y1 int")


@operator("V4 V12 V11")
def tight_boxes(v):
    """Rough boxes drawn in to their ink; null where there is none."""

    def f(r):
        page, boxes = drawn(r)
        for rid, (x0, y0, x1, y1) in zip(r.rids.tolist(), boxes):
            box = strips.ink_box(page, max(0, int(x0) - 3), max(0, int(y0) - 3), min(WIDTH, int(x1) + 3), min(HEIGHT, int(y1) + 3))
            yield (rid, *(box or (None,) * 4))

    return measure(rectangles(v), f, "page_key long, rid int, x0 double, y0 double, x1 double, y1 double")


@operator("V1 V3 V5 Q37 Q38 Q39")
def erased_labels(v):
    """Every label of a page erased for itself: background, ink left in its box, boxes lost elsewhere, and labels that overlap it."""

    def f(r):
        page, boxes = drawn(r)
        labels = [(int(x0), int(y0), min(int(x1), WIDTH), int(y1)) for x0, y0, x1, y1 in boxes]
        for k, (rid, (x0, y0, x1, y1), (residue, lost)) in enumerate(zip(r.rids.tolist(), labels, strips.erasures(page, labels))):
            over = sum(i != k and a < x1 and x0 < c and b < y1 and y0 < d for i, (a, b, c, d) in enumerate(labels))
            yield rid, strips.PAPER, residue, lost, over

    return measure(rectangles(v), f, "page_key long, rid long, paper int, residue int, lost int, overlaps int")


@operator("V6 V10 Q14")
def densities(v):
    """The share of cells dense with ink, how much of a page's crop is foreign to the page and to the next one, and which it was taken from.

    A crop belongs to a page if at most 8 % of its ink has no ink of the page within two pixels. Crops are shifted by a pixel, as
    rendering does.
    """

    def f(r):
        im = image(r.boxes)
        d, crop = raster.density(im), np.roll(im, 1, axis=1)
        own = raster.stray_share(crop, im)
        other = None if r.others is None else raster.stray_share(crop, image(r.others))
        yield float((d > 0.2).mean()), own, other, own <= 0.08, int(raster.upscale(im, 2).shape[1])

    own = rectangles(v).select("page_key", "boxes")
    pages = own.join(own.select((F.col("page_key") - 1).alias("page_key"), F.col("boxes").alias("others")), "page_key", "left")
    return measure(pages, f, "page_key long, dense double, own double, foreign double, belongs boolean, doubled int")
