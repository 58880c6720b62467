import pytest

from marlstone.sources.csv_io import MAX_CELL, CsvError, parse_records, read_csv, write_csv
from marlstone.sources.store import csv_to_store, export_column, store_to_csv
from marlstone.types import make_schema

STOCK = make_schema(["sku", "label", "units"], ["int64", "string", "int32"])
WIDE3 = make_schema(["a", "b", "c"], ["string"] * 3)
ONE = make_schema(["word"], ["string"])


def _read(spark, tmp_path, text, schema, **kw):
    (tmp_path / "in.csv").write_bytes(text.encode())
    return [tuple(r) for r in read_csv(spark, str(tmp_path / "in.csv"), schema, **kw).collect()]


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_record_ends(spark, tmp_path, end, last):
    rows = [(704, "copper wire", -12), (9_000_000_000, "ß-ring", 0), (3, "", 2_147_483_647)]
    text = end.join(f"{a},{b},{c}" for a, b, c in rows) + end * last
    assert _read(spark, tmp_path, text, STOCK, line_sep=end) == rows


def test_one_column_is_read_strictly(spark, tmp_path):
    assert _read(spark, tmp_path, 'top\n\n"a\nb"\n', ONE) == [("top",), ("",), ("a\nb",)]
    assert _read(spark, tmp_path, "word\r\nx\r\n", ONE, header=True, line_sep="\r\n") == [("x",)]
    assert _read(spark, tmp_path, "7\n-8\n", make_schema(["n"], ["int16"])) == [(7,), (-8,)]
    for text, schema in (('"open', ONE), ('"""\n', ONE), ("a,b\n", ONE), ("1\n\n2\n", make_schema(["n"], ["int16"])), ("70000\n", make_schema(["n"], ["int16"]))):
        with pytest.raises(Exception, match="quoting|cells|empty cell|CAST|OVERFLOW"):
            _read(spark, tmp_path, text, schema)


def test_empty_strings_are_no_nulls(spark, tmp_path):
    assert _read(spark, tmp_path, ',"",\n', WIDE3) == [("", "", "")]


def test_empty_number_raises(spark, tmp_path):
    with pytest.raises(Exception, match="empty cell"):
        _read(spark, tmp_path, "1,x,\n", STOCK)


@pytest.mark.parametrize("text", ["a,b\n", "a,b,c,d\n"])
def test_ragged_record_raises(spark, tmp_path, text):
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        _read(spark, tmp_path, text, WIDE3)


def test_no_columns_and_bad_options_raise(spark):
    for kw in ({"sep": ";;"}, {"line_sep": "x"}):
        with pytest.raises(CsvError):
            read_csv(spark, "/nowhere", WIDE3, **kw)
    with pytest.raises(CsvError):
        read_csv(spark, "/nowhere", make_schema([], []))


def test_header_delimiter_quotes(spark, tmp_path):
    assert _read(spark, tmp_path, 'x;y;z\n"a;""b""\n";" c ";d\n', WIDE3, sep=";", header=True) == [('a;"b"\n', " c ", "d")]


def test_long_cell_raises(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        _read(spark, tmp_path, "x" * (MAX_CELL + 1) + ",b,c\n", WIDE3)


@pytest.mark.parametrize("parts", [1, 2, 3])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_round_trip(spark, tmp_path, parts, end):
    rows = [(1, 'say "hi"', 2), (2, "a,b", 3), (3, f"line{end}end", 4), (4, "", 5), (5, " sp ", 6)]
    df = spark.createDataFrame(rows, STOCK).repartition(parts)
    write_csv(df, str(tmp_path / "o"), line_sep=end)
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "o"), STOCK, line_sep=end).collect()) == rows


def test_store_conversions(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,2,first,4\n5,1,second,2\n8,17,third,2\n")
    (tmp_path / "s.csv").write_text("a,int64\nb,int64\nname123,string\nd,int64\n")
    store = str(tmp_path / "store")
    csv_to_store(spark, str(tmp_path / "in.csv"), str(tmp_path / "s.csv"), store)
    store_to_csv(spark, store, str(tmp_path / "back"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "back")).collect()) == ['"1","2","first","4"', '"5","1","second","2"', '"8","17","third","2"']
    export_column(spark, store, "name123", str(tmp_path / "one"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "one")).collect()) == ['"first"', '"second"', '"third"']


def test_strict_records():
    assert parse_records(",,\n", 3) == [["", "", ""]]
    assert parse_records('"a""b"\r\n"\r\n,\r"', 1, line_sep="\r\n") == [['a"b'], ["\r\n,\r"]]
    assert parse_records('""', 1) == [[""]]
    for bad in ('"', '"""', '",1,2,3,'):
        with pytest.raises(CsvError):
            parse_records(bad, 1)
    with pytest.raises(CsvError):
        parse_records(",\r\n,,", 2, line_sep="\r\n")
    with pytest.raises(CsvError):
        parse_records(",,,", 0)
