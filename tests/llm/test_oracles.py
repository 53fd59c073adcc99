"""Operator queries that SQL can express give that SQL's rows; every query is registered."""

import re

import duckdb
import pytest

import __spark_entry__
from foliomill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    cur = c.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    df = QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(str(r[k]) for k in cols) for r in df.collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(re.match(rf"op{n}_", q) for q in names) for n in range(1, 11)) and "pipeline" in names
