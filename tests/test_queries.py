"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tallyframe.plans.catalog import ORACLES, QUERIES
from tallyframe.sources.tables import BASE


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLES:
        return
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = r.fetchall()
    order = sorted(names)
    assert sorted(repr([plain(row[c]) for c in order]) for row in got) == sorted(repr([plain(row[names.index(c)]) for c in order]) for row in want)
