"""Folds on pages against plain Python, on chains and random boxes."""

import random

import pytest
from pyspark.sql import functions as F

from foliomill.operators import gates, regions

SCHEMA = "page_key long, rid long, x0 double, y0 double, x1 double, y1 double"


def groups(spark, rows):
    df = regions.page_boxes(spark.createDataFrame(rows, SCHEMA))
    got = df.select("page_key", F.explode(regions.touching_groups(F.col("bs"))).alias("g")).collect()
    return {(r["page_key"], tuple(sorted(b["rid"] for b in r["g"]["m"]))) for r in got}


@pytest.mark.parametrize("n", [1, 20, 100])
def test_chains_stay_together(spark, n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    rows = [(1, k, 10.0 * i, 0.0, 10.0 * i + 11, 5.0) for k, i in enumerate(order)] + [(1, n, 0.0, 50.0, 9.0, 55.0), (2, 0, 0.0, 0.0, 1.0, 1.0)]
    assert groups(spark, rows) == {(1, tuple(range(n))), (1, (n,)), (2, (0,))}


def test_random_boxes(spark):
    r = random.Random(3)
    boxes = [(x, y, x + r.randrange(5, 60), y + r.randrange(3, 20)) for x, y in ((r.randrange(500), r.randrange(300)) for _ in range(120))]
    root = list(range(len(boxes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(boxes):
        for j, b in enumerate(boxes[:i]):
            if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                root[find(i)] = find(j)
    want = {}
    for i in range(len(boxes)):
        want.setdefault(find(i), []).append(i)
    assert groups(spark, [(1, i, *map(float, b)) for i, b in enumerate(boxes)]) == {(1, tuple(g)) for g in want.values()}


def test_touching_only_is_apart(spark):
    assert len(groups(spark, [(1, 0, 0.0, 0.0, 10.0, 5.0), (1, 1, 10.0, 0.0, 20.0, 5.0)])) == 2


def test_a_wrong_page_count_fails_the_job(spark):
    df = spark.createDataFrame([(1, 2, 2), (2, 3, 3)], "doc_id long, pages long, want long")
    assert gates.strict(df).count() == 2
    with pytest.raises(Exception, match="wrong number of pages"):
        gates.strict(df.withColumn("want", F.lit(3))).collect()
