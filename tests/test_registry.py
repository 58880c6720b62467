import glob
import os

import duckdb
import pandas as pd
import pytest

from marlstone.plans.registry import REGISTRY

SF = "/root/testdata/sf0.01"


def _cells(df):
    c = sorted(df.columns)
    out = []
    for row in df[c].itertuples(index=False):
        out.append(repr(tuple(None if v is None or v is pd.NA or v is pd.NaT or v != v else pd.Timestamp(v) if hasattr(v, "year") else v.item() if hasattr(v, "item") else v for v in row)))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = REGISTRY[name].run(spark, SF).toPandas(), con.execute(REGISTRY[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns) and _cells(got) == _cells(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first().c > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
