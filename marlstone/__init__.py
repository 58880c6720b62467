"""marlstone: a small Spark-first analytics engine over declared-schema tables."""

from marlstone.operators.aggregate import AggSpec, aggregate
from marlstone.operators.relational import filter_rows, scan
from marlstone.functions.expressions import add, col, compare, lit
from marlstone.plans.canned import run_query
from marlstone.session import get_session
from marlstone.types import load_schema, parse_schema

__all__ = ["AggSpec", "add", "aggregate", "col", "compare", "filter_rows", "get_session", "lit", "load_schema", "parse_schema", "run_query", "scan"]
