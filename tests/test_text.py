"""Golden rows and negative controls of the functions that scan text."""

import re

import pytest

from foliomill.functions import text
from foliomill.operators.details import ATOM
from foliomill.operators.pages import SYMBOLS
from foliomill.operators.scans import kept
from foliomill.operators.strings import COLLAPSE_CASES, FULL_WIDTH_CASES, WRAP_CASES


@pytest.mark.parametrize("given,want", FULL_WIDTH_CASES)
def test_full_width(given, want):
    assert text.full_width(given) == want and text.full_width(want) == want


def test_full_width_leaves_other_texts():
    assert text.full_width("a, b; (c)") == "a, b; (c)" and text.full_width(None) is None and text.full_width("") == ""


@pytest.mark.parametrize("given,want", COLLAPSE_CASES)
def test_collapse(given, want):
    assert text.collapse_repeats(given) == want


@pytest.mark.parametrize("given,width,want", WRAP_CASES)
def test_wrap(given, width, want):
    assert text.wrap(given, width) == want


def test_keep_rule(spark):
    cases = {"80020610": True, "A-1": True, "CUSTOMER": False, "3/8": True, "3/8 text": False, "": True, "...": True, "D-55": True}
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    assert {r["text"]: r["k"] for r in df.select("text", kept("text").alias("k")).collect()} == cases


def line(key, words, y, x=50.0, size=10.0, width=None):
    return text.Line(key, words, size, x, y, x + (width or 5.0 * len(words)), y + 10)


def texts(lines):
    return [x.text for x in lines]


def test_broken_leaders_join_in_pairs():
    a = [line(0, "Safety ...", 0), line(1, "... 12", 12), line(2, "Parts .....", 24), line(3, "..... x .....", 36), line(4, "..... 3", 48), line(5, "End", 60)]
    assert texts(text.join_leaders(a)) == ["Safety 12", "Parts x .....", "..... 3", "End"]
    assert text.join_leaders([]) == []


def test_wrapped_lines():
    join = lambda *rows: texts(text.join_wrapped(list(rows)))
    assert join(line(0, "the shaft and", 0), line(1, "its bearing", 12)) == ["the shaft and its bearing"]
    assert join(line(0, "It ends here.", 0), line(1, "its bearing", 12)) == ["It ends here.", "its bearing"]
    assert join(line(0, "the shaft and", 0), line(1, "its bearing", 20)) == ["the shaft and", "its bearing"]
    assert join(line(0, "the shaft of", 0), line(1, "its bearing", 12, x=80)) == ["the shaft of", "its bearing"]
    assert join(line(0, "1. the shaft is", 0), line(1, "listed below", 12, x=80)) == ["1. the shaft is listed below"]
    assert join(line(0, "title of the", 0, x=100, width=100), line(1, "drawing", 12, x=120, width=60)) == ["title of the drawing"]
    assert join(line(0, "(see table)", 0), line(1, "its bearing", 12)) == ["(see table)", "its bearing"]
    assert join(line(0, "ab", 0), line(1, "its bearing", 12)) == ["ab", "its bearing"]


def test_a_column_goes_on_past_its_neighbour():
    rows = [line(0, "left column goes", 0), line(1, "right column text", 0, x=300), line(2, "on below", 12)]
    assert texts(text.join_wrapped(rows)) == ["left column goes", "right column text", "on below"]
    assert texts(text.join_wrapped(rows, [])) == ["left column goes on below", "right column text"]
    assert texts(text.join_wrapped(rows, [(11.0, 0.0, 200.0)])) == ["left column goes", "right column text", "on below"]
    listed = [line(0, "2. left column goes", 0), line(1, "right column text", 0, x=300), line(2, "on below", 12, x=70)]
    assert texts(text.join_wrapped(listed)) == ["2. left column goes on below", "right column text"]


def test_clean_does_all_in_order():
    rows = [line(0, "\uf061 angle ......", 0), line(1, "...... 7", 12), line(2, "pump pump seal ..... 4", 30)]
    symbols = {0xF000 + k: c for k, c in SYMBOLS.items()}
    out = text.clean(rows, symbols)
    assert texts(out) == ["α angle 7", "pump seal … 4"] and out[0].y1 == 22 and out[0].key == 0


def test_atoms():
    found = lambda s: [m[1] for m in re.finditer(ATOM, s)]
    assert found("(lb) 5-1/2 IF; 80020610, 2020-08-17, 08/17/2020") == ["(lb)", "5-1/2 IF", "80020610", "2020-08-17", "08/17/2020"]
    assert found("200-675-1500 10,000 psi 30-35 4.75\"") == ["200-675-1500", "10,000 psi", "30-35", '4.75"']
    assert found("ASTM E384 a bc") == ["ASTM E384"] and found("") == []
