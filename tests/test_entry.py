import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def key(row):
    return tuple((v is None, str(v)) for v in row)


#: Those of the corpus operators are tested beside them.
NAMES = [n for n in e.QUERIES if n in e.ORACLES]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df, sql = e.queries()[name](spark, SF), con.sql(e.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, sql.select(*columns).fetchall()))


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_fits_give_full_lists(spark):
    for name in ("als_fit", "bpr_fit", "lmf_fit"):
        assert e.queries()[name](spark, SF).count() > 0
