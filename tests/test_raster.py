"""Pixel functions on small images, each with a negative control, and the page queries built on them."""

import numpy as np

from foliomill.functions import raster
from foliomill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def page():
    return raster.draw([(10, 10, 40, 22), (100, 10, 140, 22), (10, 60, 60, 75)], 200, 100)


def test_boxes_of_text():
    assert len(raster.text_boxes(page())) == 3
    assert raster.text_boxes(raster.draw([], 50, 50)) == []
    assert raster.ink_box(page(), 5, 5, 50, 30) == (12, 12, 37, 20) and raster.ink_box(page(), 70, 5, 90, 30) is None


def flood(mask):
    """The boxes of connected parts, one pixel at a time."""
    seen, out = set(), []
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in seen:
            continue
        part, todo = [], [(y, x)]
        seen.add((y, x))
        while todo:
            a, b = todo.pop()
            part.append((a, b))
            for p in range(a - 1, a + 2):
                for q in range(b - 1, b + 2):
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and (p, q) not in seen:
                        seen.add((p, q))
                        todo.append((p, q))
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return sorted(out, key=lambda b: (b[1], b[0], b[2], b[3]))


def test_components_against_flood_fill():
    r = np.random.default_rng(4)
    for share in (0.1, 0.3, 0.5, 0.8):
        mask = r.random((25, 40)) < share
        assert raster.components(mask) == [tuple(map(int, b)) for b in flood(mask)]
    assert raster.components(np.zeros((3, 3), dtype=bool)) == []


def test_parts_are_joined_in_two_steps():
    assert raster.joined([(0, 0, 2, 2), (5, 0, 7, 2), (20, 0, 22, 2)], 4, 0) == [(0, 0, 7, 2), (20, 0, 22, 2)]
    assert len(raster.detect(page())) == 3 and raster.detect(raster.draw([], 50, 50)) == []


def test_margins_erasure_and_crops():
    im = page()
    assert raster.margin_ink(im, 0, 0, 200, 100) == 0 and raster.margin_ink(im, 90, 0, 200, 100) > 0
    out = raster.erase(im, (10, 10, 40, 22))
    assert len(raster.text_boxes(out)) == 2 and raster.paper(im) == 255
    assert raster.stray_share(im, im) == 0 and raster.stray_share(im, raster.draw([], 200, 100)) == 1
    assert raster.stray_share(im, np.roll(im, 1, axis=1)) == 0 and raster.stray_share(im, np.roll(im, 45, axis=0)) > 0.08
    assert raster.upscale(im, 2).shape == (200, 400) and raster.density(im).max() > 0


def test_page_queries(spark):
    erased = QUERIES["erased_labels"](spark, SF).collect()
    assert len(erased) > 5000 and all(r["residue"] == 0 for r in erased) and any(r["overlaps"] for r in erased)
    d = QUERIES["densities"](spark, SF).collect()
    assert all(r["own"] == 0 and r["belongs"] and r["doubled"] == 840 for r in d)
    foreign = [r["foreign"] for r in d if r["foreign"] is not None]
    assert foreign and sum(f > 0.08 for f in foreign) > 0.9 * len(foreign)
    tight = QUERIES["tight_boxes"](spark, SF).where("x0 IS NOT NULL").collect()
    assert tight and all(r["x0"] < r["x1"] and r["y0"] < r["y1"] for r in tight)


def test_layout_and_locator(spark):
    rows = QUERIES["block_layout"](spark, SF).collect()
    assert rows and all(r["bottom"] >= r["top"] >= 72 for r in rows)
    m = {r["method"] for r in QUERIES["last_resort_locator"](spark, SF).collect()}
    assert m <= {"rule", "locator"} and m
