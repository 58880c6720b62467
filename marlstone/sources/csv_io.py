"""CSV with a declared schema, RFC 4180 quoting and no NULLs.

Spark's reader yields NULL for an empty cell; here an empty string cell is ``''`` and an empty cell of any other type is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.casts import DATE_FORMAT, TIMESTAMP_FORMAT, from_text

#: Longest cell accepted, in characters.
MAX_CELL = 1 << 20


class CsvError(ValueError):
    """Text that is no CSV of the declared width."""


def _options(sep: str, line_sep: str) -> dict[str, str]:
    if len(sep) != 1:
        raise CsvError(f"the delimiter is one character, not {sep!r}")
    if line_sep not in ("\n", "\r\n"):
        raise CsvError(f"the record end is LF or CRLF, not {line_sep!r}")
    return {"sep": sep, "quote": '"', "escape": '"', "lineSep": line_sep, "dateFormat": DATE_FORMAT}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", line_sep: str = "\n", header: bool = False, multi_line: bool = True, timestamp_format: str = TIMESTAMP_FORMAT) -> DataFrame:
    """A DataFrame without NULLs. ``multi_line=False`` lets Spark split large files whose cells hold no record end; with it each file is one task."""
    if not schema.fields:
        raise CsvError("a schema of no columns reads nothing")
    if len(schema.fields) == 1:
        return _read_one_column(spark, path, schema, sep, line_sep, header, timestamp_format)
    raw = (
        spark.read.schema(schema)
        .options(**_options(sep, line_sep), mode="FAILFAST", header=str(header).lower(), enforceSchema="true", multiLine=str(multi_line).lower(), maxCharsPerColumn=str(MAX_CELL))
        .option("timestampNTZFormat", timestamp_format)
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
    out = []
    for f in schema.fields:
        c = raw[f"`{f.name}`"]
        if isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(c, F.lit("")).alias(f.name))
        else:
            out.append(F.coalesce(c, F.raise_error(F.lit(f"empty cell in column {f.name}")).cast(f.dataType)).alias(f.name))
    return raw.select(*out)


def _read_one_column(spark: SparkSession, path: str, schema: T.StructType, sep: str, line_sep: str, header: bool, timestamp_format: str) -> DataFrame:
    """By the strict grammar: of one column, Spark's reader drops blank records and takes an unclosed quote for text. Each file is one task."""
    _options(sep, line_sep)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("value").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in parse_records(text, 1, sep, line_sep)][int(header) :], pa.string())], names=["value"])

    f = schema.fields[0]
    value = F.col("value")
    if not isinstance(f.dataType, T.StringType):
        full = F.when(value != "", value).otherwise(F.raise_error(F.lit(f"empty cell in column {f.name}")).cast("string"))
        value = F.to_timestamp_ntz(full, F.lit(timestamp_format)) if isinstance(f.dataType, T.TimestampNTZType) else from_text(full, f.dataType)
    return spark.read.text(path, wholetext=True).mapInArrow(cells, "value string").select(value.alias(f.name))


def _cell(c: Column, kind: T.DataType, timestamp_format: str) -> Column:
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        c = F.date_format(c, timestamp_format)
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def write_csv(df: DataFrame, path: str, sep: str = ",", line_sep: str = "\n", header: bool = False, timestamp_format: str = TIMESTAMP_FORMAT, mode: str = "error") -> None:
    """Every cell quoted, inner quotes doubled. Floating point keeps Spark's shortest form that reads back to the same number.

    Spark's CSV writer turns a line feed inside a cell into the record end, so CRLF records are composed here and written as text.
    """
    if line_sep == "\r\n":
        _options(sep, line_sep)
        lines = df.select(F.concat_ws(sep, *(_cell(df[f"`{f.name}`"], f.dataType, timestamp_format) for f in df.schema.fields)).alias("value"))
        if header:
            raise CsvError("no header with CRLF records")
        lines.write.mode(mode).option("lineSep", line_sep).text(path)
        return
    (
        df.write.mode(mode)
        .options(**_options(sep, line_sep), quoteAll="true", header=str(header).lower(), emptyValue="", nullValue="")
        .option("timestampNTZFormat", timestamp_format)
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def parse_records(text: str, n_cols: int, sep: str = ",", line_sep: str = "\n") -> list[list[str]]:
    """The strict grammar for small texts (schema files, fixtures): a broken quote, a ragged record or a cell beyond ``MAX_CELL`` raises."""
    if n_cols < 1:
        raise CsvError("records of no columns")
    s, end = re.escape(sep), re.escape(line_sep)
    cell = re.compile(rf'(?:"((?:[^"]|"")*)"|((?:(?!{end})[^"{s}])*))({s}|{end}|\Z)', re.S)
    rows: list[list[str]] = []
    row: list[str] = []
    at = 0
    while at < len(text) or row:
        m = cell.match(text, at)
        if m is None:
            raise CsvError(f"broken quoting at character {at}")
        value = m[1].replace('""', '"') if m[1] is not None else m[2]
        if len(value) > MAX_CELL:
            raise CsvError(f"cell of {len(value)} characters")
        row.append(value)
        at = m.end()
        if m[3] != sep:
            if len(row) != n_cols:
                raise CsvError(f"record {len(rows) + 1} has {len(row)} cells, {n_cols} expected")
            rows.append(row)
            row = []
            if not m[3]:
                break
    return rows
