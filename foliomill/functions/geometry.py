"""Rectangle arithmetic as columns. A rectangle is four columns with a common prefix: x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(p: str, c: str) -> Column:
    return F.col(f"{p}{c}")


def area(p: str = "") -> Column:
    return (col(p, "x1") - col(p, "x0")) * (col(p, "y1") - col(p, "y0"))


def shared(a: str, b: str) -> Column:
    """The area of the intersection; 0 for rectangles that only touch, and for lines."""
    side = lambda lo, hi: F.greatest(F.least(col(a, hi), col(b, hi)) - F.greatest(col(a, lo), col(b, lo)), F.lit(0))
    return side("x0", "x1") * side("y0", "y1")


def inside(a: str, b: str, slack: float) -> Column:
    """a within b by coordinates, so that lines count too."""
    return (col(a, "x0") >= col(b, "x0") - slack) & (col(a, "y0") >= col(b, "y0") - slack) & (col(a, "x1") <= col(b, "x1") + slack) & (col(a, "y1") <= col(b, "y1") + slack)


def gap(a: str, b: str) -> Column:
    """The larger of the horizontal and vertical distances, 0 if the rectangles meet."""
    return F.greatest(col(b, "x0") - col(a, "x1"), col(a, "x0") - col(b, "x1"), col(b, "y0") - col(a, "y1"), col(a, "y0") - col(b, "y1"), F.lit(0))
