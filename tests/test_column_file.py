import datetime as dt
import struct

import pytest

from marlstone.sources.column_file import read_column_file, read_footer, write_column_file

ROWS = [(1, 2, "first", 4), (5, 1, "second", 2), (8, 17, "third", 2)]


@pytest.mark.parametrize("batch", [500_000, 1, 2, 3])
def test_round_trip_for_each_batch_size(spark, tmp_path, batch):
    path = str(tmp_path / "t.col")
    write_column_file(spark.createDataFrame(ROWS, "a long, b long, name123 string, d long"), path, batch)
    assert sorted(tuple(r) for r in read_column_file(spark, path).collect()) == ROWS
    got = read_column_file(spark, path, ["name123", "a"])
    assert got.columns == ["a", "name123"] and sorted(tuple(r) for r in got.collect()) == [(a, n) for a, _, n, _ in ROWS]


def test_layout(spark, tmp_path):
    path = tmp_path / "t.col"
    write_column_file(spark.createDataFrame(ROWS, "a long, b long, name123 string, d long").coalesce(1), str(path))
    data = path.read_bytes()
    assert len(data) == 180 and struct.unpack("<q", data[:8]) == (49,) and read_footer(str(path))[2:] == ([8], 131)


def test_types_and_refusals(spark, tmp_path):
    rows = [(1, 2, dt.date(1974, 3, 1), dt.datetime(2013, 7, 15, 1, 2, 3), 1.5, "ж")]
    path = str(tmp_path / "t.col")
    write_column_file(spark.createDataFrame(rows, "a smallint, b int, d date, t timestamp_ntz, x double, s string"), path)
    assert [tuple(r) for r in read_column_file(spark, path).collect()] == rows
    for schema, row in (("f boolean", (True,)), ("s string", ("a\x1fb",)), ("s string", (None,))):
        with pytest.raises(ValueError):
            write_column_file(spark.createDataFrame([row], schema), path)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "t.col")
    write_column_file(spark.createDataFrame([], "a long"), path)
    assert read_column_file(spark, path).count() == 0
