"""Small raster functions over uint8 grey images (0 is ink, 255 paper), one image at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

INK = 128


def draw(boxes: list[tuple[float, float, float, float]], w: int, h: int) -> np.ndarray:
    """A page with the outlines and a text-like comb in each box."""
    im = np.full((h, w), 255, dtype=np.uint8)
    for x0, y0, x1, y1 in boxes:
        a, b, c, d = (int(max(0, min(v, m))) for v, m in ((x0, w), (y0, h), (x1, w), (y1, h)))
        im[b + 2 : max(b + 2, d - 2), a + 2 : c - 2 : 2] = 30
    return im


def ink(im: np.ndarray) -> np.ndarray:
    return im < INK


def paper(im: np.ndarray) -> int:
    """The background: the median of what isn't ink."""
    dark = ink(im)
    n = im.size - np.count_nonzero(dark)
    if 2 * np.count_nonzero(im == 255) > n:  # no value is above, so these reach the middle
        return 255
    return int(np.median(im[~dark])) if n else 255


def ink_box(im: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> tuple[int, int, int, int] | None:
    """The tight box of the ink within a rough box."""
    part = ink(im[y0:y1, x0:x1])
    ys, xs = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
    return None if not len(ys) else (x0 + int(xs[0]), y0 + int(ys[0]), x0 + int(xs[-1]) + 1, y0 + int(ys[-1]) + 1)


def runs(mask: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Start and end of runs of true values, joined over gaps of at most `gap`."""
    at = mask.nonzero()[0]
    if not len(at):
        return []
    cut = (at[1:] - at[:-1] > gap + 1).nonzero()[0].tolist()
    return [(int(at[i]), int(at[j]) + 1) for i, j in zip([0, *(k + 1 for k in cut)], [*cut, -1])]


def text_boxes(im: np.ndarray, gap_x: int = 6, gap_y: int = 2) -> list[tuple[int, int, int, int]]:
    """Boxes of connected ink after bridging small gaps: rows first, then columns in each, until a box no longer parts."""
    found, stack = [], [(0, 0, im.shape[1], im.shape[0])]
    mask = ink(im)
    while stack:
        x0, y0, x1, y1 = stack.pop()
        part = mask[y0:y1, x0:x1]
        rows = runs(part.any(axis=1), gap_y)
        cols = [(r, runs(part[r[0] : r[1]].any(axis=0), gap_x)) for r in rows]
        boxes = [(x0 + c[0], y0 + r[0], x0 + c[1], y0 + r[1]) for r, cs in cols for c in cs]
        if boxes == [(x0, y0, x1, y1)]:
            found.append(boxes[0])
        else:
            stack += boxes
    return sorted(found, key=lambda b: (b[1], b[0]))


Box = tuple[int, int, int, int]


def parts(mask: np.ndarray) -> np.ndarray:
    """The boxes of the parts of a mask that are connected sideways, up, down or across corners, by top and left edge.

    Runs of each column (strokes are upright, so there are fewer than in rows) are united with those of the next one that they touch.
    """
    h, w = mask.shape
    edge = np.zeros((h + 1, w), dtype=bool)
    edge[:-1], edge[-1] = mask, mask[-1:].any(axis=0)
    edge[1:-1] ^= mask[:-1]
    y, x = np.divmod(edge.ravel().nonzero()[0], w)
    at = np.sort(x * (h + 2) + y)  # a start and an end in turn
    since, to = at[::2], at[1::2]
    x, top = np.divmod(since, h + 2)
    box = np.stack([x, top, x + 1, to - x * (h + 2)], axis=1)
    first, last = np.searchsorted(to, since + h + 2), np.searchsorted(since, to + h + 2, "right")
    touch = (last > first).nonzero()[0]
    if len(touch):
        root = list(range(len(box)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, a, b in zip(touch.tolist(), first[touch].tolist(), last[touch].tolist()):
            for j in range(a, b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
        of = np.array([find(i) for i in range(len(root))])
        order = np.argsort(of, kind="stable")
        box = united(box[order], np.diff(of[order], prepend=-1).nonzero()[0])
    return box[np.lexsort(box.T[[3, 2, 0, 1]])]


def united(box: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One box around each stretch of boxes, by where it begins."""
    return np.concatenate([np.minimum.reduceat(box[:, :2], at), np.maximum.reduceat(box[:, 2:], at)], axis=1)


def components(mask: np.ndarray) -> list[Box]:
    """The parts of a mask as a list."""
    return list(map(tuple, parts(mask).tolist()))


def joined(boxes: list[Box] | np.ndarray, dx: int, dy: int) -> list[Box]:
    """Boxes joined while they are at most dx apart sideways and dy up or down: neighbours in the list at once, then what is left."""
    box = np.asarray(boxes).reshape(-1, 4)
    if len(box) > 1:
        a, b = box[:-1], box[1:]
        far = (a[:, 0] - dx > b[:, 2]) | (b[:, 0] - dx > a[:, 2]) | (a[:, 1] - dy > b[:, 3]) | (b[:, 1] - dy > a[:, 3])
        box = united(box, np.append(0, far.nonzero()[0] + 1))
    return closed(map(tuple, box.tolist()), dx, dy)


def closed(boxes: Iterable[Box], dx: int, dy: int) -> list[Box]:
    """Boxes joined one after the other while they are at most dx apart sideways and dy up or down."""
    out: list[Box] = []
    for b in boxes:
        while True:
            near = [o for o in out if o[0] - dx <= b[2] and b[0] - dx <= o[2] and o[1] - dy <= b[3] and b[1] - dy <= o[3]]
            if not near:
                break
            out = [o for o in out if o not in near]
            b = (min(b[0], *(o[0] for o in near)), min(b[1], *(o[1] for o in near)), max(b[2], *(o[2] for o in near)), max(b[3], *(o[3] for o in near)))
        out.append(b)
    return sorted(out, key=lambda b: (b[1], b[0]))


def detect(im: np.ndarray, smallest: int = 6) -> list[Box]:
    """Boxes of text: parts of the ink joined to words (4 pixels sideways), then to lines (10), without specks below `smallest` pixels."""
    words = joined(parts(ink(im)), 4, 0)
    return [b for b in joined(words, 10, 0) if (b[2] - b[0]) * (b[3] - b[1]) >= smallest]


def erase(im: np.ndarray, box: tuple[int, int, int, int], fill: int | None = None) -> np.ndarray:
    """The image with a box filled by its background."""
    out = im.copy()
    x0, y0, x1, y1 = box
    out[y0:y1, x0:x1] = paper(im) if fill is None else fill
    return out


def erasures(im: np.ndarray, boxes: list[Box], gap_y: int = 2) -> list[tuple[int, int]]:
    """For each box erased for itself: ink left in it, and how many text boxes fewer the image has.

    Bands of rows with ink part the image before all else, so only those that a box meets are looked at again.
    """
    fill = paper(im)
    bands = [(a, b, len(text_boxes(im[a:b]))) for a, b in runs(ink(im).any(axis=1), gap_y)]
    out = []
    for x0, y0, x1, y1 in boxes:
        met = [b for b in bands if b[0] < y1 and y0 < b[1]]
        if not met:
            out.append((0, 0))
            continue
        top, end = met[0][0], met[-1][1]
        box = (x0, max(0, y0 - top), x1, max(0, y1 - top))
        rest = erase(im[top:end], box, fill)
        out.append((int(np.count_nonzero(ink(rest[box[1] : box[3], x0:x1]))), sum(b[2] for b in met) - len(text_boxes(rest, gap_y=gap_y))))
    return out


def margin_ink(im: np.ndarray, left: int, top: int, right: int, bottom: int) -> int:
    """Ink pixels outside the margins."""
    m = ink(im)
    return int(np.count_nonzero(m) - np.count_nonzero(m[top:bottom, left:right]))


def stray_share(crop: np.ndarray, page: np.ndarray, reach: int = 2) -> float:
    """The share of a crop's ink that has no ink of the page within reach."""
    m, grown = ink(crop), ink(page)
    for axis in (0, 1):  # rows, then columns: together a square
        wide = grown.copy()
        for d in range(1, reach + 1):
            to, since = (slice(d, None), slice(None, -d)) if axis == 0 else ((slice(None), slice(d, None)), (slice(None), slice(None, -d)))
            wide[to] |= grown[since]
            wide[since] |= grown[to]
        grown = wide
    return float(np.count_nonzero(m > grown) / max(1, np.count_nonzero(m)))


def density(im: np.ndarray, cell: int = 8) -> np.ndarray:
    """Ink share by cells."""
    h, w = im.shape[0] // cell * cell, im.shape[1] // cell * cell
    rows = np.add.reduce(ink(im[:h, :w]).view(np.uint8).reshape(h // cell, cell, w), axis=1, dtype=np.uint16 if cell > 255 else np.uint8)
    return rows.reshape(h // cell, w // cell, cell).sum(axis=2) / cell**2


def upscale(im: np.ndarray, k: int) -> np.ndarray:
    """Enlarged k times by repeating pixels, the fallback of the enlarging backends."""
    h, w = im.shape
    out = np.empty((h, k, w, k), dtype=im.dtype)
    for j in range(k):
        out[:, 0, :, j] = im
    out[:, 1:] = out[:, :1]
    return out.reshape(h * k, w * k)
