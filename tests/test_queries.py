"""Every registered query of the library proper against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from corpus_guard.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect())
    assert rows, "no rows"
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
