"""Operators over two tables and over ordered groups: joins, set operations, window columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of join by equal keys.
JOINS = ("inner", "left", "right", "full", "semi", "anti")


def _same_columns(left: DataFrame, right: DataFrame) -> None:
    if left.columns != right.columns:
        raise ValueError(f"the tables have different columns: {', '.join(left.columns)} and {', '.join(right.columns)}")


def join(left: DataFrame, right: DataFrame, keys: Sequence[str] | Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Rows with equal keys: names that both tables have, or pairs of a left and a right name. Columns that both tables have besides the keys are refused, since the result could not name them.
    Spark broadcasts the smaller side by its measured size and splits skewed keys (AQE)."""
    if how not in JOINS:
        raise ValueError(f"unknown join {how!r}; known: {' '.join(JOINS)}")
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    if unknown := [a for a, _ in pairs if a not in left.columns] + [b for _, b in pairs if b not in right.columns]:
        raise ValueError(f"no column {', '.join(unknown)}")
    shared = all(a == b for a, b in pairs)
    if how not in ("semi", "anti") and (twice := (set(left.columns) & set(right.columns)) - ({a for a, _ in pairs} if shared else set())):
        raise ValueError(f"both tables have {', '.join(sorted(twice))}")
    if shared:
        return left.join(right, [a for a, _ in pairs], how)
    condition = F.lit(True)
    for a, b in pairs:
        condition &= left[f"`{a}`"] == right[f"`{b}`"]
    return left.join(right, condition, how)


def union(left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    _same_columns(left, right)
    both = left.unionByName(right)
    return both.distinct() if distinct else both


def intersect(left: DataFrame, right: DataFrame, distinct: bool = True) -> DataFrame:
    _same_columns(left, right)
    return left.intersect(right) if distinct else left.intersectAll(right)


def subtract(left: DataFrame, right: DataFrame, distinct: bool = True) -> DataFrame:
    _same_columns(left, right)
    return left.subtract(right) if distinct else left.exceptAll(right)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, first: int | None = None) -> DataFrame:
    """The row's number within its group as ``name``, and with ``first`` only rows up to it: Spark then keeps that many rows of a group before the shuffle (WindowGroupLimit)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if first is None else out.where(F.col(name) <= first)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], aggregates: dict[str, Column], rows: int | None = None) -> DataFrame:
    """Aggregates over a group's rows up to the present one, or over the last ``rows`` rows."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, Window.currentRow)
    return df.withColumns({name: c.over(frame) for name, c in aggregates.items()})
