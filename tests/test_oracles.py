"""Every query with SQL gives that SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from foliomill.plans.catalog import COVERS, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


#: Scans with memory, solvers and pixels: what built-in functions can't express.
PYTHON = {"cleaned_lines", "full_width_cases", "full_width_lines", "collapse_cases", "wrap_cases", "block_layout", "last_resort_locator", "ink_outside_margins", "detected_text", "tight_boxes", "erased_labels", "densities"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols, kinds = [d[0] for d in cur.description], {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert [c for c, k in df.dtypes if k in KINDS and KINDS[k] != kinds[c]] == []
    names = sorted(cols)
    assert sorted(tuple(shown(r[n]) for n in names) for r in df.collect()) == sorted(tuple(shown(r[cols.index(n)]) for n in names) for r in want)


def test_every_query_says_what_it_covers():
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())


def test_plans_stay_in_the_engine(spark):
    """Only the text scans use Python; filters reach the scan."""
    for name, q in QUERIES.items():
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        python = "ArrowEvalPython" in plan or "Pandas" in plan
        assert python == (name in PYTHON), name
        assert "CartesianProduct" not in plan, name
