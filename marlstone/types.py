"""Logical type names and declared schemas.

A schema file is a header-less two-column CSV of ``name,type``. Nothing is inferred.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: The spelling of each logical type in a schema file. Names are case-sensitive.
LOGICAL_TYPES: dict[str, T.DataType] = {
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "string": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "double": T.DoubleType(),
    "long double": T.DoubleType(),
    "bool": T.BooleanType(),
}


class SchemaError(ValueError):
    """A schema file or a name/type pairing that cannot be used."""


def to_spark_type(name: str) -> T.DataType:
    try:
        return LOGICAL_TYPES[name]
    except KeyError:
        raise SchemaError(f"unknown type name {name!r}; known: {', '.join(LOGICAL_TYPES)}") from None


def to_logical_name(kind: T.DataType) -> str:
    for name, known in LOGICAL_TYPES.items():
        if known == kind:
            return name
    raise SchemaError(f"{kind.simpleString()} has no logical type name")


def make_schema(names: list[str], types: list[str]) -> T.StructType:
    """Pair names with logical types. Unlike SQL identifiers they must differ by more than case, so that every column stays addressable."""
    if len(names) != len(types):
        raise SchemaError(f"{len(names)} names but {len(types)} types")
    folded: set[str] = set()
    for name in names:
        if name.lower() in folded:
            raise SchemaError(f"column {name!r} occurs twice")
        folded.add(name.lower())
    return T.StructType([T.StructField(n, to_spark_type(t), True) for n, t in zip(names, types, strict=True)])


def parse_schema(text: str, sep: str = ",") -> T.StructType:
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=True) if r]
    for n, row in enumerate(rows, 1):
        if len(row) != 2:
            raise SchemaError(f"schema record {n} has {len(row)} cells, 2 expected")
    return make_schema([r[0] for r in rows], [r[1] for r in rows])


def load_schema(spark: SparkSession, path: str, sep: str = ",") -> T.StructType:
    """Read a schema file through Spark, so that any storage Spark knows will do."""
    files = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(files) != 1:
        raise SchemaError(f"{path}: one schema file expected")
    return parse_schema(files[0][0], sep)
