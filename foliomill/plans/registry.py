"""Queries by name, each with the inventory rows it covers and, where SQL can express it, its DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from foliomill.sources.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}
#: SQL as it was given, without the views it needs, for use inside other SQL.
RAW: dict[str, str] = {}


def with_views(sql: str) -> str:
    """sql led by the view definitions that it needs, in order of definition."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text, re.I):
                need.add(name)
                visit(VIEW_SQL[name])

    visit(sql)
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in VIEW_SQL if n in need]
    body = sql.strip()
    recursive = ""
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        recursive = "RECURSIVE " if m[1] else ""
        if not ctes:
            return body
        return f"WITH {recursive}{', '.join(ctes)}, {body[m.end():]}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def operator(ids: str, oracle: str | None = None, big: str = ""):
    """Registers f(views) under its name. ids: inventory rows; big: oracle columns to be read as BIGINT."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Views(spark, sf_dir))
            return df.select([F.col(f"`{c.name}`").cast("long").alias(c.name) if isinstance(c.dataType, IntegerType) else F.col(f"`{c.name}`") for c in df.schema])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        COVERS[f.__name__] = ids.split()
        if oracle:
            RAW[f.__name__] = oracle.strip()
            sql = with_views(oracle)
            if big:
                sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in big.split())}) FROM ({sql})"
            ORACLES[f.__name__] = sql
        return f

    return add
