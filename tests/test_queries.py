"""Every registered query of the core against its SQL in DuckDB."""

import math

import duckdb
import pytest

from pulsegrid.plans import files  # noqa: F401
from pulsegrid.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "to_integral_value"):
        return float(v) if v != int(v) else int(v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(plain(x) for x in r) for r in df.select(*names).collect()]
    assert rows
    if name not in Q.SQL:
        return
    found = duck.sql(Q.SQL[name])
    assert sorted(found.columns) == names
    at = [list(found.columns).index(c) for c in names]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]

    def close(a, b):
        return a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5 * max(1, abs(a))

    rows, want = sorted(rows, key=repr), sorted(want, key=repr)
    assert len(rows) == len(want)
    assert all(close(a, b) for x, y in zip(rows, want) for a, b in zip(x, y))
