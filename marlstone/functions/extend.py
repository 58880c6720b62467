"""User functions, vectorised over Arrow batches, for what built-in functions cannot express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, function: Callable, returns: str) -> Callable:
    """``function`` maps pandas Series to a Series of the same length; usable on columns and, by ``name``, in SQL."""
    return spark.udf.register(name, F.pandas_udf(function, returns))


def register_aggregate(spark: SparkSession, name: str, function: Callable, returns: str) -> Callable:
    """``function`` maps the Series of a whole group to one value, so a group has to fit a task; the built-in aggregates do not have that bound. Its parameters and result need type hints."""
    return spark.udf.register(name, F.pandas_udf(function, returns))
