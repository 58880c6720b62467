"""Casts between logical types; text forms are those of the CSV sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text forms of dates and timestamps.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def to_text(column: Column, kind: T.DataType) -> Column:
    """Integers plain, floating point with six decimals, dates and timestamps in the fixed forms; fractions of a second are dropped."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(column.isNotNull(), F.format_string("%.6f", column))
    if isinstance(kind, T.DateType):
        return F.date_format(column, DATE_FORMAT)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(column, TIMESTAMP_FORMAT)
    return column.cast("string")


def from_text(column: Column, kind: T.DataType) -> Column:
    """Strict: text that is no value of the type raises, as does a number out of range."""
    if isinstance(kind, T.DateType):
        return F.to_date(column, DATE_FORMAT)
    if isinstance(kind, T.TimestampNTZType):
        return F.to_timestamp_ntz(column, F.lit(TIMESTAMP_FORMAT))
    return column.cast(kind)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast column by column, by position, to another schema of the same width; names are taken from it too."""
    if len(df.columns) != len(schema):
        raise ValueError(f"{len(df.columns)} columns cannot take a schema of {len(schema)}")
    out = []
    for have, want in zip(df.schema.fields, schema.fields, strict=True):
        c = df[f"`{have.name}`"]
        if have.dataType == want.dataType:
            cast = c
        elif isinstance(want.dataType, T.StringType):
            cast = to_text(c, have.dataType)
        elif isinstance(have.dataType, T.StringType):
            cast = from_text(c, want.dataType)
        else:
            cast = c.cast(want.dataType)
        out.append(cast.alias(want.name))
    return df.select(*out)
