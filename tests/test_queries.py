"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import os
from collections import Counter

import duckdb
import pytest

from lodestone import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(repr(tuple(plain(v) for v in r)) for r in df.select(*names).collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == names
    want = Counter(repr(tuple(plain(v) for v in r)) for r in duck.sql(f"select {', '.join(names)} from ({sql.strip()})").fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
