"""Strips against images: each function gives what the one of raster.py gives for an image drawn from the same boxes."""

import tracemalloc

import numpy as np
import pytest

from foliomill.functions import raster, strips

W, H = 120, 70


def pages():
    """Pages with no, few and many boxes: apart, one over the other, beyond the edges, without ink."""
    r = np.random.default_rng(5)
    yield []
    yield [(5.0, 5.0, 9.0, 30.0), (5.0, 5.0, 60.0, 9.0), (150.0, 90.0, 180.0, 99.0)]
    for n in (1, 2, 3, 4, 6, 9, 15, 30, 60) * 12:
        x, y = r.integers(0, W, n), r.integers(0, H, n)
        yield [(float(a), float(b), a + c / 2, b + d / 2) for a, b, c, d in zip(x.tolist(), y.tolist(), r.integers(4, 120, n).tolist(), r.integers(4, 50, n).tolist())]


@pytest.mark.parametrize("name", ["detect", "text_boxes"])
def test_boxes_of_text(name):
    got = [(getattr(strips, name)(strips.draw(b, W, H)), getattr(raster, name)(raster.draw(b, W, H))) for b in pages()]
    assert all(g == w for g, w in got) and max(len(w) for _, w in got) > 5


def test_parts_with_other_gaps():
    for b in pages():
        for gaps in ((0, 0), (1, 1), (3, 5), (9, 0)):
            assert strips.text_boxes(strips.draw(b, W, H), *gaps) == raster.text_boxes(raster.draw(b, W, H), *gaps)


def test_ink_within_and_outside():
    r = np.random.default_rng(6)
    for b in pages():
        page, im = strips.draw(b, W, H), raster.draw(b, W, H)
        for _ in range(8):
            x0, y0, x1, y1 = (int(x) for x in np.sort(r.integers(0, [[W + 1], [H + 1]], (2, 2)), axis=1).T.ravel())
            assert strips.ink_in(page, x0, y0, x1, y1) == np.count_nonzero(raster.ink(im[y0:y1, x0:x1]))
            assert strips.margin_ink(page, x0, y0, x1, y1) == raster.margin_ink(im, x0, y0, x1, y1)
            assert strips.ink_box(page, x0, y0, x1, y1) == raster.ink_box(im, x0, y0, x1, y1)


def test_erasures():
    lost = set()
    for b in pages():
        labels = [(int(x0), int(y0), min(int(x1), W), int(y1)) for x0, y0, x1, y1 in b[:12]]
        page, im = strips.draw(b[:-1], W, H), raster.draw(b[:-1], W, H)
        got = strips.erasures(page, labels)
        assert got == raster.erasures(im, labels) and raster.paper(im) == strips.PAPER
        lost |= {x for _, x in got}
    assert min(lost) < 0 < max(lost)


def test_a_page_costs_what_its_boxes_do():
    """An image of the page takes a byte for each pixel."""
    boxes = [(10.0, 10.0, 90.0, 22.0), (30.0, 40.0, 300.0, 52.0), (200.0, 190.0, 280.0, 202.0)]
    tracemalloc.start()
    page = strips.draw(boxes, 420, 230)
    found = strips.detect(page), strips.erasures(page, [(10, 10, 90, 22)]), strips.ink_box(page, 5, 5, 95, 25), strips.margin_ink(page, 10, 10, 400, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 3 and found[1] == [(0, 1)] and peak < 420 * 230 / 4
