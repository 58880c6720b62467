"""Column references, literals, the six comparisons and addition, with the operand check that SQL coercion would skip."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.types import to_spark_type

_OPS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<>": lambda a, b: a != b,
}


def col(name: str) -> Column:
    return F.col(name)


def lit(value: Any, type_name: str | None = None) -> Column:
    """A constant; ``type_name`` is a logical type name and fixes its width."""
    return F.lit(value) if type_name is None else F.lit(value).cast(to_spark_type(type_name))


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return kind.typeName()


def _families(df: DataFrame, left: Column, right: Column) -> tuple[str, str]:
    """Analysis only: no job runs."""
    fields = df.select(left.alias("l"), right.alias("r")).schema.fields
    return _family(fields[0].dataType), _family(fields[1].dataType)


def compare(df: DataFrame, left: Column, op: str, right: Column) -> Column:
    """``left op right`` for rows of ``df``. Operands of different families (a string and a number, a date and a number) are refused
    at analysis instead of being coerced; use ``unix_date`` to compare dates with day numbers."""
    if op not in _OPS:
        raise ValueError(f"unknown comparison {op!r}; known: {' '.join(_OPS)}")
    a, b = _families(df, left, right)
    if a != b and "void" not in (a, b):
        raise TypeError(f"cannot compare {a} with {b}")
    return _OPS[op](left, right)


def add(df: DataFrame, left: Column, right: Column) -> Column:
    """Element-wise addition of numbers."""
    if (found := _families(df, left, right)) != ("number", "number"):
        raise TypeError(f"cannot add {found[0]} and {found[1]}")
    return left + right
