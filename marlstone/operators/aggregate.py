"""Global aggregates in one pass: count, sum, avg, exact distinct count, min, max.

Spark plans each as partial and final aggregation. Zero rows give 0 for the counts and NULL for the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = (T.NumericType,)
_DAYS = (T.DateType,)

_KINDS = ("count", "sum", "avg", "count_distinct", "min", "max")


@dataclass(frozen=True)
class AggSpec:
    kind: str
    expr: Column
    alias: str


def _build(df: DataFrame, spec: AggSpec) -> Column:
    kind = df.select(spec.expr.alias("x")).schema[0].dataType
    if spec.kind == "count":
        out = F.count(F.lit(1))
    elif spec.kind == "count_distinct":
        out = F.count_distinct(spec.expr)
    elif spec.kind == "min":
        out = F.min(spec.expr)
    elif spec.kind == "max":
        out = F.max(spec.expr)
    elif spec.kind == "sum":
        if not isinstance(kind, _NUMBER):
            raise TypeError(f"sum takes numbers, not {kind.simpleString()}")
        out = F.sum(spec.expr)
    elif spec.kind == "avg":
        if isinstance(kind, _DAYS):
            out = F.avg(F.unix_date(spec.expr))
        elif isinstance(kind, T.TimestampNTZType):
            out = F.avg(F.unix_seconds(spec.expr.cast("timestamp")))
        elif isinstance(kind, T.TimestampType):
            out = F.avg(F.unix_seconds(spec.expr))
        elif isinstance(kind, _NUMBER):
            out = F.avg(spec.expr)
        else:
            raise TypeError(f"avg takes numbers, dates or timestamps, not {kind.simpleString()}")
    else:
        raise ValueError(f"unknown aggregate {spec.kind!r}; known: {' '.join(_KINDS)}")
    return out.alias(spec.alias)


def aggregate(df: DataFrame, specs: Sequence[AggSpec | tuple[str, Column, str]]) -> DataFrame:
    """One row with a column for each spec. ``avg`` of a date is the mean day number since 1970, of a timestamp the mean second."""
    specs = [s if isinstance(s, AggSpec) else AggSpec(*s) for s in specs]
    if not specs:
        raise ValueError("no aggregate given")
    if len({s.alias.lower() for s in specs}) < len(specs):
        raise ValueError("aggregates need different aliases")
    return df.agg(*(_build(df, s) for s in specs))
