"""Every query that has SQL gives the same rows as DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__

ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if hasattr(value, "asDict"):
        return str({k: plain(v) for k, v in value.asDict().items()})
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, duck, name):
    made = __spark_entry__.queries()[name](spark, SF_SMALL)
    columns = sorted(made.columns)
    rows = sorted(tuple(map(plain, r)) for r in made.select(*(f"`{c}`" for c in columns)).collect())
    wanted = duck.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
