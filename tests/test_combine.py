import pytest
from pyspark.sql import functions as F

from marlstone.operators.combine import intersect, join, ranked, running, subtract, union


@pytest.fixture
def two(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, x string"), spark.createDataFrame([(1, 10), (3, 30), (None, 0)], "k int, y int")


def test_joins(two):
    a, b = two
    rows = lambda how: sorted(map(repr, map(tuple, join(a, b, ["k"], how).collect())))
    assert rows("inner") == ["(1, 'a', 10)", "(1, 'b', 10)"]
    assert rows("semi") == ["(1, 'a')", "(1, 'b')"] and rows("anti") == ["(2, 'c')", "(None, 'n')"]
    assert [len(rows(h)) for h in ("left", "right", "full")] == [4, 4, 6]
    assert join(a, b.withColumnRenamed("k", "j"), [("k", "j")]).count() == 2


def test_joins_refuse(two):
    a, b = two
    for other, keys, how in ((b, ["z"], "inner"), (b, ["k"], "cross"), (b.withColumn("x", F.lit(1)), ["k"], "inner"), (b, [("k", "k"), ("x", "y")], "left")):
        with pytest.raises(ValueError):
            join(a, other, keys, how)


def test_sets(spark, two):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (None,), (None,), (5,)], "k int")
    rows = lambda df: sorted((r.k for r in df.collect()), key=lambda v: (v is None, v))
    assert rows(union(a, b)) == [1, 1, 1, 2, 5, None, None, None] and rows(union(a, b, True)) == [1, 2, 5, None]
    assert rows(intersect(a, b)) == [1, None] == rows(intersect(a, b, False))
    assert rows(subtract(a, b)) == [2] and rows(subtract(a, b, False)) == [1, 2]
    with pytest.raises(ValueError):
        union(a, two[0])


def test_windows(spark):
    t = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 4), ("b", 1, 1)], "g string, i int, v int")
    assert sorted(map(tuple, ranked(t, ["g"], [F.desc("v")], "r", 2).collect())) == [("a", 1, 5, 1), ("a", 3, 4, 2), ("b", 1, 1, 1)]
    assert sorted(map(tuple, running(t, ["g"], [F.asc("i")], {"s": F.sum("v")}).select("g", "i", "s").collect())) == [("a", 1, 5), ("a", 2, 8), ("a", 3, 12), ("b", 1, 1)]
    assert sorted(r.s for r in running(t, ["g"], [F.asc("i")], {"s": F.sum("v")}, 2).collect()) == [1, 5, 7, 8]
