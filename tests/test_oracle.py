"""Every query of the core runs on the smallest tables, and agrees with its SQL where it has one."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from docmill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    got = rows(df.columns, df.collect())
    if name in SQL:
        r = con.sql(SQL[name])
        assert sorted(df.columns) == sorted(r.columns)
        assert got == rows(r.columns, r.fetchall())
