"""Raster functions over drawn pages without their pixels: a page is a list of strips (top, end, bits), rows of the same ink with a bit for each column.

They give what the functions of the same name in raster.py give for an image drawn from the same boxes, at a cost that goes with the boxes
instead of the page's area.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from foliomill.functions.raster import Box, closed

Strip = tuple[int, int, int]
#: The background of a drawn page.
PAPER = 255


def span(x0: int, x1: int) -> int:
    """The bits of the columns from x0 to x1."""
    return (1 << x1) - (1 << x0) if x0 < x1 else 0


def draw(boxes: Iterable[tuple[float, float, float, float]], w: int, h: int) -> list[Strip]:
    """A page with a text-like comb in each box, every other column."""
    combs = []
    for x0, y0, x1, y1 in boxes:
        a, b, c, d = int(max(0, min(x0, w))), int(max(0, min(y0, h))), int(max(0, min(x1, w))), int(max(0, min(y1, h)))
        n = (c - a - 3) // 2
        if n > 0 and b + 2 < d - 2:
            combs.append((b + 2, d - 2, (1 << 2 * n) // 3 << a + 2))
    ys = sorted({y for c in combs for y in c[:2]})
    out = []
    for top, end in zip(ys, ys[1:]):
        bits = 0
        for t, e, m in combs:
            if t <= top < e:
                bits |= m
        if bits:
            out.append((top, end, bits))
    return out


def ink_in(page: list[Strip], x0: int, y0: int, x1: int, y1: int) -> int:
    """Ink pixels in a box."""
    own = span(x0, x1)
    return sum(max(0, min(e, y1) - max(t, y0)) * (bits & own).bit_count() for t, e, bits in page)


def margin_ink(page: list[Strip], left: int, top: int, right: int, bottom: int) -> int:
    """Ink pixels outside the margins."""
    return sum((e - t) * bits.bit_count() for t, e, bits in page) - ink_in(page, left, top, right, bottom)


def ink_box(page: list[Strip], x0: int, y0: int, x1: int, y1: int) -> Box | None:
    """The tight box of the ink within a rough box."""
    own, ink, top, end = span(x0, x1), 0, 0, 0
    for t, e, bits in page:
        a, b = max(t, y0), min(e, y1)
        if a < b and (bits := bits & own):
            top, end, ink = top if ink else a, b, ink | bits
    return ((ink & -ink).bit_length() - 1, top, ink.bit_length(), end) if ink else None


def columns(bits: int, gap: int) -> Iterator[int]:
    """The bits of each run of columns, joined over gaps of at most `gap`."""
    wide, n = bits, 1
    while n <= gap:  # every bit spreads over the gap after it
        step = min(n, gap + 1 - n)
        wide, n = wide | wide << step, n + step
    while wide:
        rest = wide + (wide & -wide)  # carries through the lowest run
        yield bits & wide & ~rest
        wide &= rest


def bands(page: list[Strip], gap: int) -> list[list[Strip]]:
    """Strips joined over gaps of at most `gap` rows."""
    out: list[list[Strip]] = []
    for s in page:
        if out and s[0] - out[-1][-1][1] <= gap:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def text_boxes(page: list[Strip], gap_x: int = 6, gap_y: int = 2) -> list[Box]:
    """Boxes of connected ink after bridging small gaps: rows first, then columns in each, until a box no longer parts."""
    found, stack = [], [page]
    while stack:
        for band in bands(stack.pop(), gap_y):
            ink = 0
            for _, _, bits in band:
                ink |= bits
            runs = list(columns(ink, gap_x))
            if len(runs) == 1:
                found.append(((ink & -ink).bit_length() - 1, band[0][0], ink.bit_length(), band[-1][1]))
            else:
                stack += [[(t, e, bits & run) for t, e, bits in band if bits & run] for run in runs]
    return sorted(found, key=lambda b: (b[1], b[0]))


def detect(page: list[Strip], smallest: int = 6) -> list[Box]:
    """Boxes of text: ink joined to lines (10 pixels sideways, 0 up or down), without specks below `smallest` pixels.

    Which boxes join doesn't depend on the order, and parts that touch or are 4 pixels apart are joined at 10 too, so neither the parts
    nor the words have to be found before.
    """
    ink = [((r & -r).bit_length() - 1, t, r.bit_length(), e) for t, e, bits in page for r in columns(bits, 10)]
    return [b for b in closed(ink, 10, 0) if (b[2] - b[0]) * (b[3] - b[1]) >= smallest]


def erase(page: list[Strip], box: Box) -> list[Strip]:
    """The page with a box filled by its background."""
    x0, y0, x1, y1 = box
    own, out = span(x0, x1), []
    for t, e, bits in page:
        a, b = max(t, y0), min(e, y1)
        if a >= b or not bits & own:
            out.append((t, e, bits))
            continue
        if t < a:
            out.append((t, a, bits))
        if rest := bits & ~own:
            out.append((a, b, rest))
        if b < e:
            out.append((b, e, bits))
    return out


def erasures(page: list[Strip], boxes: Iterable[Box], gap_y: int = 2) -> list[tuple[int, int]]:
    """For each box erased for itself: ink left in it, and how many text boxes fewer the page has.

    Bands part the page before all else, so only those that a box meets are looked at again.
    """
    parts = [(b[0][0], b[-1][1], len(text_boxes(b, gap_y=gap_y)), b) for b in bands(page, gap_y)]
    out = []
    for box in boxes:
        residue = lost = 0
        for top, end, n, band in parts:
            if top < box[3] and box[1] < end:
                rest = erase(band, box)
                residue += ink_in(rest, *box)
                lost += n - len(text_boxes(rest, gap_y=gap_y))
        out.append((residue, lost))
    return out
