"""Projected scan, filter and top-k. All are lazy; Catalyst prunes columns and pushes predicates into the Parquet reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, names: Sequence[str] = ()) -> DataFrame:
    """The named columns of a Parquet table in the table's own order; none named: all. An unknown name raises here, not at first use."""
    table = spark.read.parquet(path)
    if not names:
        return table
    if unknown := [n for n in names if n not in table.columns]:
        raise ValueError(f"{path} has no column {', '.join(unknown)}")
    wanted = set(names)
    return table.select(*(f"`{c}`" for c in table.columns if c in wanted))


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which a boolean predicate holds; any other type of predicate is refused at analysis."""
    kind = df.select(predicate.alias("p")).schema[0].dataType
    if not isinstance(kind, T.BooleanType):
        raise TypeError(f"a filter takes a boolean, not {kind.simpleString()}")
    return df.filter(predicate)


def top_k(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """``ORDER BY … LIMIT k OFFSET offset``, planned as TakeOrderedAndProject: each task keeps at most ``k + offset`` rows."""
    ordered = df.orderBy(*order)
    return ordered.offset(offset).limit(k) if offset else ordered.limit(k)


def group_top(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], by: str, k: int) -> DataFrame:
    """Groups by ``keys`` with the ``k`` largest values of ``by``; ties go to the smaller keys, so that the result is determined."""
    grouped = df.groupBy(*keys).agg(*aggregates)
    return top_k(grouped, [F.desc(by), *(F.asc(key) for key in keys)], k)
