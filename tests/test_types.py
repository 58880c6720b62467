import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.casts import conform, from_text, to_text
from marlstone.types import LOGICAL_TYPES, SchemaError, load_schema, make_schema, parse_schema, to_logical_name, to_spark_type


@pytest.mark.parametrize("name", ["int16", "int32", "int64", "string", "DATE", "TIMESTAMP", "double", "bool"])
def test_names_map_both_ways(name):
    assert to_logical_name(to_spark_type(name)) == name


def test_unknown_and_wrong_case_names_raise():
    for name in ("date", "INT64", "decimal"):
        with pytest.raises(SchemaError):
            to_spark_type(name)


def test_schema_text():
    s = parse_schema("a,int64\nb,string\nc,DATE\n")
    assert s.names == ["a", "b", "c"] and s["c"].dataType == T.DateType()
    for bad in ("a,int64,x", "a", "a,int64\nA,int64"):
        with pytest.raises(SchemaError):
            parse_schema(bad)
    with pytest.raises(SchemaError):
        make_schema(["a"], [])


def test_schema_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,int64\r\nname123,string\r\n")
    assert load_schema(spark, str(tmp_path / "s.csv")).names == ["a", "name123"]


def test_cast_matrix(spark):
    df = spark.createDataFrame([(1.5, 7, dt.date(1974, 3, 1), dt.datetime(2013, 7, 15, 1, 2, 3, 9))], "d double, i int, a date, t timestamp_ntz")
    got = df.select(*(to_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)).first()
    assert tuple(got) == ("1.500000", "7", "1974-03-01", "2013-07-15 01:02:03")
    back = spark.createDataFrame([got]).select(from_text(F.col("a"), LOGICAL_TYPES["DATE"]).alias("a"), from_text(F.col("t"), LOGICAL_TYPES["TIMESTAMP"]).alias("t")).first()
    assert back.a == dt.date(1974, 3, 1) and back.t == dt.datetime(2013, 7, 15, 1, 2, 3)
    assert spark.sql("SELECT unix_date(DATE'1974-03-01') d").first().d == 1520
    for text in ("40000", "12abc", ""):
        with pytest.raises(Exception, match="CAST|cast"):
            spark.createDataFrame([(text,)], "s string").select(from_text(F.col("s"), LOGICAL_TYPES["int16"])).collect()


def test_conform_renames_and_casts(spark):
    out = conform(spark.createDataFrame([("5", 2)], "a string, b int"), make_schema(["x", "y"], ["int64", "string"]))
    assert out.first().asDict() == {"x": 5, "y": "2"}
    with pytest.raises(ValueError):
        conform(out, make_schema(["x"], ["int64"]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(dt.date(1900, 1, 1), dt.date(2100, 12, 31)), min_size=1, max_size=50))
def test_dates_round_trip(spark, dates):
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    out = df.select("d", from_text(to_text(F.col("d"), T.DateType()), T.DateType()).alias("e")).collect()
    assert all(r.d == r.e for r in out)
