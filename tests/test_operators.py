import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone import add, aggregate, col, compare, filter_rows, lit, scan
from marlstone.operators.relational import group_top, top_k


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, "a", -1.5, dt.date(2020, 1, 1)), (2, "b", -2.5, dt.date(2020, 1, 3)), (2, "", -3.5, dt.date(2020, 1, 3))], "n int, s string, x double, d date")


def test_six_comparisons(table):
    counts = {op: table.filter(compare(table, col("n"), op, lit(2))).count() for op in ("<", "<=", "=", ">=", ">", "<>")}
    assert counts == {"<": 1, "<=": 3, "=": 2, ">=": 2, ">": 0, "<>": 1}


def test_operand_families(table):
    for left, right in ((col("s"), lit(1)), (col("d"), lit(1)), (col("d"), col("s"))):
        with pytest.raises(TypeError):
            compare(table, left, "=", right)
    with pytest.raises(TypeError):
        add(table, col("s"), lit(1))
    with pytest.raises(ValueError):
        compare(table, col("n"), "!!", lit(1))
    with pytest.raises(TypeError):
        filter_rows(table, col("n"))


def test_aggregates(table):
    got = aggregate(table, [("count", lit(1), "c"), ("sum", add(table, col("n"), lit(1)), "s"), ("avg", col("d"), "a"), ("count_distinct", col("s"), "u"), ("min", col("x"), "mn"), ("max", col("x"), "mx")]).first()
    assert tuple(got) == (3, 8, pytest.approx(18262 + 4 / 3), 3, -3.5, -1.5)
    for kind in ("sum", "avg"):
        with pytest.raises(TypeError):
            aggregate(table, [(kind, col("s"), "z")])
    for bad in ([], [("median", col("n"), "m")], [("min", col("n"), "z"), ("max", col("n"), "Z")]):
        with pytest.raises(ValueError):
            aggregate(table, bad)


def test_no_rows(table):
    got = aggregate(table.limit(0), [("count", lit(1), "c"), ("sum", col("n"), "s"), ("avg", col("x"), "a"), ("count_distinct", col("n"), "u"), ("min", col("n"), "mn")]).first()
    assert tuple(got) == (0, None, None, 0, None)


def test_int64_sum_overflow_raises(spark):
    df = spark.createDataFrame([(2**63 - 1,), (1,)], "n long")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        aggregate(df, [("sum", col("n"), "s")]).collect()


def test_scan(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    assert scan(spark, path, ["x", "n"]).columns == ["n", "x"]
    assert scan(spark, path).columns == table.columns
    with pytest.raises(ValueError):
        scan(spark, path, ["nope"])
    plan = filter_rows(scan(spark, path, ["n"]), F.col("n") > 1)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<n:int>" in plan and "GreaterThan(n,1)" in plan


def test_top(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "k string")
    assert [tuple(r) for r in group_top(df, ["k"], [F.count("*").alias("n")], "n", 2).collect()] == [("a", 2), ("b", 1)]
    assert [r.k for r in top_k(df, [F.asc("k")], 2, 1).collect()] == ["a", "b"]
