"""Conversions between CSV and the Parquet store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.operators.relational import scan
from marlstone.sources.csv_io import read_csv, write_csv
from marlstone.types import load_schema


def csv_to_store(spark: SparkSession, csv_path: str, schema: T.StructType | str, out: str, sep: str = ",", line_sep: str = "\n", mode: str = "error", partition_by: Sequence[str] = (), **csv_options) -> None:
    """``schema`` is a StructType or the path of a schema file."""
    declared = load_schema(spark, schema) if isinstance(schema, str) else schema
    read_csv(spark, csv_path, declared, sep, line_sep, **csv_options).write.mode(mode).partitionBy(*partition_by).parquet(out)


def store_to_csv(spark: SparkSession, path: str, out: str, names: Sequence[str] = (), sep: str = ",", line_sep: str = "\n", mode: str = "error") -> None:
    write_csv(scan(spark, path, names), out, sep, line_sep, mode=mode)


def export_column(spark: SparkSession, path: str, name: str, out: str, mode: str = "error") -> None:
    store_to_csv(spark, path, out, [name], mode=mode)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "error") -> None:
    """A table bucketed and sorted by a join or grouping key, so that later joins and aggregates on it need no exchange."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
