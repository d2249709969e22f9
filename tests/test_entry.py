"""The registered queries run and agree with their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _values(frame):
    columns = sorted(frame.columns)
    clean = lambda x: "NULL" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    return columns, sorted(tuple(map(clean, r)) for r in frame[columns].itertuples(index=False))


def _names():
    from fathomline.plans import answers, evaluation, retrieval

    return sorted({**retrieval.ORACLES, **evaluation.ORACLES, **answers.ORACLES})


@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(spark, name):
    import __spark_entry__

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert _values(got) == _values(con.execute(__spark_entry__.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
