"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from epochal.plans import queries

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't there")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "year"):
        return str(x)[:19]
    return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") or type(x).__name__ == "Decimal" else str(x)


def rows(names, found):
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    found = [r.asDict() for r in got.collect()]
    if name not in queries.ORACLE_SQL:
        assert found
        return
    want = db.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    assert names == sorted(got.columns)
    order = [d[0] for d in want.description]
    assert rows(names, found) == rows(names, [dict(zip(order, r, strict=True)) for r in want.fetchall()])


@pytest.mark.parametrize("name", ["f16_strings", "f3_integer_width"])
def test_same_rows_of_large_keys(spark, tmp_path, name):
    c = duckdb.connect()
    for t, key in (("part", "p_partkey"), ("orders", "o_orderkey")):
        c.execute(f"copy (select * replace ({key} + 1234567 * (i % 3) as {key}) from '{SF}/{t}.parquet', range(3) r(i)) to '{tmp_path}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = c.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in want.description]
    assert rows(order, [r.asDict() for r in got.collect()]) == rows(order, [dict(zip(order, r, strict=True)) for r in want.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
