"""Every registered query of the library proper against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from trailmill.jobs.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame: pd.DataFrame) -> list:
    def one(x):
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return ""
        if isinstance(x, bool) or str(x) in ("True", "False"):
            return str(bool(x))
        return x if isinstance(x, str) else f"{float(x):.9g}" if not math.isinf(float(x)) else str(x)

    frame = frame[sorted(frame.columns)]
    return [list(frame.columns), sorted(tuple(map(one, r)) for r in frame.itertuples(index=False))]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
