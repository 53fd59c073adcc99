"""Text functions that need a scan with memory; Arrow-batched, one call a batch.

Each takes and returns a string column; null stays null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of text that keeps its punctuation: links, tags, thousands, clock times, decimals, abbreviations, part numbers, ranges, fractions.
PROTECTED = (
    r"https?://\S*[\w/]",
    r"www\.\S*[\w/]",
    r"<[^>]+>",
    r"\d+(?:,\d{3})+(?:\.\d+)?",
    r"\d{1,2}:\d{2}(?::\d{2})?",
    r"\d+\.\d+",
    r"[A-Za-z]{1,6}\.\s?\d[\w.\-]*",
    r"[A-Za-z]{1,5}\d[\w.\-/]*",
    r"\d+\s*[-–]\s*\d+",
    r"\d+/\d+",
)
# Fixed pairs of half-width and full-width marks.
FULL_WIDTH = str.maketrans(",;:?!()", "，；：？！（）")
_KEEP = re.compile("|".join(PROTECTED))
_HAN = re.compile("[一-鿿]")
_WIDE = re.compile("[一-鿿＀-￯　-〿]")
_HUGS_LEFT, _HUGS_RIGHT = "，。；：？！）（", "，。；：？！（"


def full_width(text: str | None) -> str | None:
    """Half-width punctuation of a text with Han characters as full-width; other texts and protected parts stay."""
    if text is None:
        return None
    text = text.replace(" ", " ").replace("‑", "-").replace("­", "")
    if not _HAN.search(text):
        return text
    cells: list[tuple[str, bool]] = []  # a character and whether it is protected
    at = 0
    for m in [*_KEEP.finditer(text), None]:
        stop = m.start() if m else len(text)
        cells += [(c, False) for c in text[at:stop].translate(FULL_WIDTH)]
        if m:
            cells += [(c, True) for c in m[0]]
            at = m.end()
    last = len(text.rstrip()) - 1
    out: list[tuple[str, bool]] = []
    for i, (c, held) in enumerate(cells):
        if c == "." and not held and (i == last or (out and not out[-1][1] and _WIDE.match(out[-1][0]))):
            c = "。"
        if not held and c in "，。" and out and out[-1] == (c, False):
            continue
        if not held and c in _HUGS_LEFT:
            while out and out[-1][0] in " \t" and not out[-1][1]:
                out.pop()
        if not held and c in " \t" and out and not out[-1][1] and out[-1][0] in _HUGS_RIGHT:
            continue
        if _HAN.match(c):
            k = len(out)
            while k and out[k - 1][0] in " \t" and not out[k - 1][1]:
                k -= 1
            if k and out[k - 1] == ("）", False):
                del out[k:]
        out.append((c, held))
    return "".join(c for c, _ in out)


def _runs(flags: np.ndarray) -> np.ndarray:
    """How many flags in a row are set from each place on."""
    ends = np.flatnonzero(np.append(~flags, True))
    return ends[np.searchsorted(ends, np.arange(len(flags)))] - np.arange(len(flags))


def collapse_repeats(text: str | None) -> str | None:
    """Word sequences that follow themselves reduced to one, the longest first, until none is left."""
    if text is None:
        return None
    w = text.split()
    codes = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if w else np.empty(0, np.int64)
    size, found = len(w) // 2, False
    while size:
        # a sequence of that length follows itself only where as many words in a row equal those one length on
        same = codes[:-size] == codes[size:]
        hit = False
        if np.count_nonzero(same) >= size:
            i, keep, n = 0, [], len(w)
            run = _runs(same)
            start = 0
            while i + 2 * size <= n:
                if run[i] >= size:
                    hit = found = True
                    # all further repeats of the sequence go with the first
                    keep += range(start, i + size)
                    i += size
                    while i + size <= n and (codes[i : i + size] == codes[i - size : i]).all():
                        i += size
                    start = i
                else:
                    i += 1
            keep += range(start, n)
            if hit:
                w, codes = [w[k] for k in keep], codes[keep]
        size = len(w) // 2 if hit else size - 1
    return " ".join(w) if found else text


# Fixed patterns: leaders at an end and at a head, ends of sentences, closing marks, list numbers, words that go on.
_LEADS, _LEAD_HEAD = re.compile(r"\.{3,}\s*$"), re.compile(r"^\s*\.{3,}")
_ENDS, _SHUT = re.compile(r"[.:;?!][”\")\]]?\s*$|^\S{1,3}$"), re.compile(r"[)\]”\"]\s*$")
_LISTED, _GOES_ON = re.compile(r"^\s*(?:\d{1,2}|[A-Za-z])[.)]\s"), re.compile(r"(?:,|&|\b(?:and|or|of|the|with|to|for))\s*$", re.I)


@dataclass
class Line:
    """A line with its box; key names the line it began with."""

    key: int
    text: str
    size: float
    x0: float
    y0: float
    x1: float
    y1: float

    def add(self, other: Line, text: str) -> Line:
        return replace(self, text=" ".join(text.split()), x0=min(self.x0, other.x0), y0=min(self.y0, other.y0), x1=max(self.x1, other.x1), y1=max(self.y1, other.y1))


def join_leaders(lines: list[Line]) -> list[Line]:
    """Lines that end in a leader joined with the next one where that begins with one; each joins one other at most."""
    out: list[Line] = []
    open_lead = False
    for x in lines:
        if open_lead and _LEAD_HEAD.match(x.text):
            last = out.pop()
            out.append(last.add(x, _LEADS.sub(" ", last.text) + " " + _LEAD_HEAD.sub("", x.text)))
            open_lead = False
        else:
            out.append(x)
            open_lead = bool(_LEADS.search(x.text))
    return out


def goes_on(a: Line, b: Line, max_gap: float = 3.0, tolerance: float = 6.0) -> bool:
    """Whether b continues a: a has no end, b stands tightly below, and their left edges agree, b hangs below a number, or both are centred."""
    if _ENDS.search(a.text) or (_SHUT.search(a.text) and len(a.text) < 40):
        return False
    gap, height = b.y0 - a.y1, min(a.y1 - a.y0, b.y1 - b.y0)
    if not -0.35 * height <= gap <= max_gap:
        return False
    hangs = bool(_LISTED.match(a.text)) and 0 < b.x0 - a.x0 <= 4 * max(a.size, 0.8 * (b.y1 - b.y0))
    centred = abs(a.x0 + a.x1 - b.x0 - b.x1) / 2 <= tolerance and bool(_GOES_ON.search(a.text))
    return abs(a.x0 - b.x0) <= tolerance or hangs or centred


def join_wrapped(lines: list[Line], rules: list[tuple[float, float, float]] | None = None) -> list[Line]:
    """Wrapped lines joined with the one they continue, which may stand some places back if it is 30 points up at most.

    Further back than the line before, only a numbered one is continued, or one with no rule (y, x0, x1) in between where rules are known.
    """
    out: list[Line] = []
    for x in sorted(lines, key=lambda r: (round(r.y0, 1), r.x0)):
        for j in range(len(out) - 1, -1, -1):
            a = out[j]
            if a.y1 < x.y0 - 33.0:
                j = -1
                break
            far = j < len(out) - 1 and not (_LISTED.match(a.text) and x.x0 > a.x0)
            parted = rules is None or any(min(a.y0 + a.y1, x.y0 + x.y1) < 2 * y < max(a.y0 + a.y1, x.y0 + x.y1) and r0 <= min(a.x1, x.x1) and r1 >= max(a.x0, x.x0) for y, r0, r1 in rules)
            if goes_on(a, x) and not (far and parted):
                out[j] = a.add(x, a.text + " " + x.text)
                break
        else:
            j = -1
        if j < 0:
            out.append(x)
    return out


def normal_leaders(text: str) -> str:
    return " ".join(re.sub(r"\.{3,}", " … ", text).split())


def clean(lines: list[Line], symbols: dict[int, str], rules: list[tuple[float, float, float]] | None = None) -> list[Line]:
    """Leaders joined, wrapped lines joined, symbols mapped, leaders normalised, repeats collapsed, in this order."""
    joined = join_wrapped(join_leaders(lines), rules)
    return [replace(x, text=collapse_repeats(normal_leaders(x.text.translate(symbols)))) for x in joined]


def clean_page(page: pd.DataFrame) -> pd.DataFrame:
    from foliomill.operators.pages import SYMBOLS

    rows = page.sort_values(["y0", "x0", "line_no"])
    lines = [Line(r.line_no, r.text, r.size, r.x0, r.y0, r.x1, r.y1) for r in rows.itertuples()]
    out = clean(lines, {0xF000 + k: c for k, c in SYMBOLS.items()})
    return pd.DataFrame([(page["doc_id"].iloc[0], x.key, x.text, x.x0, x.y0, x.x1, x.y1) for x in out], columns=["doc_id", "line_no", "text", "x0", "y0", "x1", "y1"])


# Fixed marks that may not begin or end a line.
NO_HEAD, NO_TAIL = "，。；：？！）、》」』】%°", "（《「『【"


def em(c: str) -> float:
    """The width estimate of a character: 1 beyond U+2E80, else 0.55."""
    return 1.0 if ord(c) > 0x2E80 else 0.55


def wrap(text: str, width: float) -> list[str]:
    """Lines of at most width ems: Latin words stay whole, no line begins or ends with a mark that mayn't."""
    lines, line, used = [], "", 0.0
    for token in re.findall(r"[A-Za-z0-9.\-/]+|\s+|.", text):
        w = sum(map(em, token))
        if line and used + w > width and token not in NO_HEAD:
            carried = ""
            while line and line[-1] in NO_TAIL:
                line, carried = line[:-1], line[-1] + carried
            if line:
                lines.append(line.rstrip())
            line, used = carried, sum(map(em, carried))
            if token.isspace():
                continue
        line += token
        used += w
    return [*lines, line.rstrip()] if line.strip() else lines


_TOKEN = re.compile(r"[A-Za-z0-9.\-/]+")


def _count_lines(text: pd.Series, width: pd.Series) -> pd.Series:
    """How many lines wrap() gives: one for a single word, else counted once a batch for each pair of text and width."""
    known: dict[tuple[str, float], int] = {}
    out = []
    for pair in zip(text, width):
        n = known.get(pair)
        if n is None:
            t = pair[0]
            n = known[pair] = None if t is None else 1 if _TOKEN.fullmatch(t) else len(wrap(*pair))
        out.append(n)
    return pd.Series(out, dtype="Int32")


def _full_width_all(s: pd.Series) -> pd.Series:
    return s.map(full_width, na_action="ignore")


def _collapse_all(s: pd.Series) -> pd.Series:
    return s.map(collapse_repeats, na_action="ignore")


def full_width_udf(c) -> Column:
    return F.pandas_udf(_full_width_all, "string")(c)


def collapse_repeats_udf(c) -> Column:
    return F.pandas_udf(_collapse_all, "string")(c)


def _wrap_all(text: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else wrap(t, w) for t, w in zip(text, width)], dtype=object)


def wrap_udf(text, width) -> Column:
    return F.pandas_udf(_wrap_all, "array<string>")(text, width)


def count_lines_udf(text, width) -> Column:
    return F.pandas_udf(_count_lines, "int")(text, width)
