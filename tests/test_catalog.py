"""Every query against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from vellumlake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    cur = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in rows), key=repr)
    assert got == want
