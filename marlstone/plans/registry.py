"""Named queries over the driver's tables, each with the SQL it must agree with where SQL can express it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.casts import from_text, to_text
from marlstone.functions.expressions import add, col, compare, lit
from marlstone.functions.extend import register_aggregate, register_scalar
from marlstone.operators.aggregate import aggregate
from marlstone.operators.combine import intersect, join, ranked, running, subtract, union
from marlstone.operators.relational import filter_rows, group_top, scan, top_k
from marlstone.sources.column_file import read_column_file, write_column_file
from marlstone.sources.csv_io import read_csv, write_csv
from marlstone.sources.store import csv_to_store, export_column, store_to_csv
from marlstone.streaming.ingest import csv_stream, stream_to_store, windowed_counts
from marlstone.types import load_schema, to_logical_name, to_spark_type

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str


REGISTRY: dict[str, Entry] = {}


def _put(name: str, sql: str, run: Query) -> None:
    REGISTRY[name] = Entry(run, sql)


def _agg(name: str, table: str, specs: Callable[[], list[tuple[str, Column, str]]], sql: str) -> None:
    _put(name, sql, lambda s, d: aggregate(scan(s, f"{d}/{table}.parquet"), specs()))


def _counted(name: str, table: str, left: Callable[[], Column], op: str, right: Callable[[], Column], where: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        t = scan(s, f"{d}/{table}.parquet")
        return aggregate(filter_rows(t, compare(t, left(), op, right())), [("count", lit(1), "c")])

    _put(name, f"SELECT count(*) AS c FROM {table} WHERE {where}", run)


def _mapped(name: str, table: str, key: str, value: Callable[[], Column], sql_value: str) -> None:
    _put(name, f"SELECT {key}, {sql_value} AS v FROM {table}", lambda s, d: scan(s, f"{d}/{table}.parquet").select(key, value().alias("v")))


def _day() -> Column:
    return F.col("ts").cast("date")


def _fill() -> None:
    _agg("q0_count", "lineitem", lambda: [("count", lit(1), "c")], "SELECT count(*) AS c FROM lineitem")
    _counted("q1_filter_ne_count", "lineitem", lambda: col("l_linenumber"), "<>", lambda: lit(1), "l_linenumber <> 1")
    _agg("q2_multi_agg", "lineitem", lambda: [("sum", col("l_linenumber"), "s"), ("count", lit(1), "c"), ("avg", col("l_quantity"), "a")], "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS c, avg(l_quantity) AS a FROM lineitem")
    _agg("q3_avg_int64", "events", lambda: [("avg", col("user_id"), "a")], "SELECT avg(user_id) AS a FROM events")
    _agg("q4_count_distinct_int", "events", lambda: [("count_distinct", col("user_id"), "c")], "SELECT count(DISTINCT user_id) AS c FROM events")
    _agg("q5_count_distinct_str", "events", lambda: [("count_distinct", col("event_type"), "c")], "SELECT count(DISTINCT event_type) AS c FROM events")
    _agg("q6_min_max_date", "events", lambda: [("min", _day(), "mn"), ("max", _day(), "mx")], "SELECT min(CAST(ts AS DATE)) AS mn, max(CAST(ts AS DATE)) AS mx FROM events")

    _put("scan_project", "SELECT l_orderkey, l_quantity FROM lineitem", lambda s, d: scan(s, f"{d}/lineitem.parquet", ["l_quantity", "l_orderkey"]))
    _put("scan_all", "SELECT * FROM nation", lambda s, d: scan(s, f"{d}/nation.parquet"))

    def rows(s: SparkSession, d: str) -> DataFrame:
        t = scan(s, f"{d}/events.parquet", ["event_id", "event_type"])
        return filter_rows(t, compare(t, col("event_type"), "<>", lit("view")))

    _put("filter_rows", "SELECT event_id, event_type FROM events WHERE event_type <> 'view'", rows)
    for name, op in (("ne", "<>"), ("lt", "<"), ("le", "<="), ("eq", "="), ("gt", ">"), ("ge", ">=")):
        _counted(f"filter_{name}", "lineitem", lambda: col("l_quantity"), op, lambda: lit(25), f"l_quantity {op} 25")
    _counted("filter_ne_string", "events", lambda: col("event_type"), "<>", lambda: lit("error"), "event_type <> 'error'")
    _counted("cmp_col_col", "lineitem", lambda: col("l_partkey"), "<>", lambda: col("l_suppkey"), "l_partkey <> l_suppkey")
    _counted("cmp_mixed_width", "lineitem", lambda: col("l_linenumber"), "<>", lambda: col("l_quantity"), "l_linenumber <> l_quantity")

    def added(s: SparkSession, d: str) -> DataFrame:
        t = scan(s, f"{d}/lineitem.parquet", ["l_linenumber"])
        return aggregate(t, [("sum", add(t, col("l_linenumber"), lit(1)), "s")])

    _put("expr_add", "SELECT CAST(sum(l_linenumber + 1) AS BIGINT) AS s FROM lineitem", added)
    _put("sum_double", "SELECT round(sum(l_tax), 2) AS s FROM lineitem", lambda s, d: aggregate(scan(s, f"{d}/lineitem.parquet"), [("sum", col("l_tax"), "s")]).select(F.round("s", 2).alias("s")))
    _put("avg_double", "SELECT round(avg(l_discount), 6) AS a FROM lineitem", lambda s, d: aggregate(scan(s, f"{d}/lineitem.parquet"), [("avg", col("l_discount"), "a")]).select(F.round("a", 6).alias("a")))
    _agg("avg_date_days", "events", lambda: [("avg", _day(), "a")], "SELECT avg(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS a FROM events")
    _agg("count_distinct_date", "events", lambda: [("count_distinct", _day(), "c")], "SELECT count(DISTINCT CAST(ts AS DATE)) AS c FROM events")
    _agg("count_distinct_double", "lineitem", lambda: [("count_distinct", col("l_quantity"), "c")], "SELECT count(DISTINCT l_quantity) AS c FROM lineitem")
    for name, table, c in (("int", "lineitem", "l_linenumber"), ("double", "events", "value"), ("timestamp", "events", "ts"), ("string", "events", "event_type")):
        _agg(f"min_max_{name}", table, lambda c=c: [("min", col(c), "mn"), ("max", col(c), "mx")], f"SELECT min({c}) AS mn, max({c}) AS mx FROM {table}")

    def none(s: SparkSession, d: str) -> DataFrame:
        t = scan(s, f"{d}/lineitem.parquet")
        n = col("l_linenumber")
        return aggregate(filter_rows(t, compare(t, n, "<>", n)), [("count", lit(1), "c"), ("sum", n, "s"), ("avg", col("l_quantity"), "a"), ("min", n, "mn"), ("max", n, "mx"), ("count_distinct", col("l_suppkey"), "d")])

    _put("empty_agg", "SELECT count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_quantity) AS a, min(l_linenumber) AS mn, max(l_linenumber) AS mx, count(DISTINCT l_suppkey) AS d FROM lineitem WHERE l_linenumber <> l_linenumber", none)

    int32, int16, double = to_spark_type("int32"), to_spark_type("int16"), to_spark_type("double")
    date, stamp = to_spark_type("DATE"), to_spark_type("TIMESTAMP")
    _mapped("cast_int_to_string", "lineitem", "l_orderkey", lambda: to_text(col("l_linenumber"), int32), "CAST(l_linenumber AS VARCHAR)")
    _mapped("cast_string_to_int", "lineitem", "l_orderkey", lambda: from_text(to_text(col("l_linenumber"), int32), int16), "CAST(CAST(l_linenumber AS VARCHAR) AS SMALLINT)")
    _mapped("cast_long_to_double", "events", "event_id", lambda: col("user_id").cast(double), "CAST(user_id AS DOUBLE)")
    _mapped("cast_double_to_string", "lineitem", "l_orderkey", lambda: to_text(col("l_extendedprice"), double), "printf('%.6f', l_extendedprice)")
    _mapped("cast_date_to_string", "events", "event_id", lambda: to_text(_day(), date), "strftime(CAST(ts AS DATE), '%Y-%m-%d')")
    _mapped("cast_ts_to_string", "events", "event_id", lambda: to_text(col("ts"), stamp), "strftime(ts, '%Y-%m-%d %H:%M:%S')")
    _mapped("cast_string_to_date", "events", "event_id", lambda: from_text(to_text(col("ts"), stamp).substr(1, 10), date), "CAST(strftime(ts, '%Y-%m-%d') AS DATE)")

    for table in ("nation", "documents", "pages", "events"):
        _put(f"csv_roundtrip_{table}", f"SELECT * FROM {table}", lambda s, d, t=table: csv_round_trip(s, scan(s, f"{d}/{t}.parquet")))

    _put("csv_crlf_nation", "SELECT * FROM nation", lambda s, d: csv_round_trip(s, scan(s, f"{d}/nation.parquet"), line_sep="\r\n"))
    _put("csv_header_delimiter", "SELECT * FROM region", lambda s, d: csv_round_trip(s, scan(s, f"{d}/region.parquet"), sep=";", header=True))
    _put("schema_file_conversions", "SELECT c_custkey, c_name, c_acctbal FROM customer", lambda s, d: converted(s, scan(s, f"{d}/customer.parquet", ["c_custkey", "c_name", "c_acctbal"])))
    _put("column_export", "SELECT c_mktsegment FROM customer", lambda s, d: exported(s, f"{d}/customer.parquet", "c_mktsegment"))
    _put("stream_to_store", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem", lambda s, d: streamed(s, scan(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_returnflag"])))
    _put("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL", lambda s, d: stream_counted(s, f"{d}/events.parquet"))

    _put("column_file_roundtrip", "SELECT * FROM nation", lambda s, d: column_file_round_trip(s, scan(s, f"{d}/nation.parquet")))
    _put("boolean_connectives", "SELECT count(*) AS c FROM events WHERE event_type IN ('click', 'view') AND NOT (user_id < 10 OR value IS NULL) AND props LIKE '%{%'", lambda s, d: scan(s, f"{d}/events.parquet").filter(F.col("event_type").isin("click", "view") & ~((F.col("user_id") < 10) | F.col("value").isNull()) & F.col("props").like("%{%")).agg(F.count(F.lit(1)).alias("c")))

    def n() -> Column:
        return F.count(F.lit(1)).alias("c")

    _put("group_count_top", "SELECT user_id, count(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10", lambda s, d: group_top(scan(s, f"{d}/events.parquet", ["user_id"]), ["user_id"], [n()], "c", 10))
    _put("group_two_keys_top", "SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10", lambda s, d: group_top(scan(s, f"{d}/events.parquet", ["user_id", "event_type"]), ["user_id", "event_type"], [n()], "c", 10))
    _put("group_distinct_top", "SELECT l_suppkey, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY l_suppkey ORDER BY u DESC, l_suppkey LIMIT 10", lambda s, d: group_top(scan(s, f"{d}/lineitem.parquet"), ["l_suppkey"], [F.count_distinct("l_partkey").alias("u")], "u", 10))
    _put("group_mixed_aggs", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS c, avg(l_quantity) AS a, count(DISTINCT l_suppkey) AS u FROM lineitem GROUP BY l_returnflag", lambda s, d: scan(s, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("s"), n(), F.avg("l_quantity").alias("a"), F.count_distinct("l_suppkey").alias("u")))
    _put("group_minute_top", "SELECT user_id, CAST(extract(minute FROM ts) AS INTEGER) AS m, count(*) AS c FROM events GROUP BY user_id, m ORDER BY c DESC, user_id, m LIMIT 10", lambda s, d: group_top(scan(s, f"{d}/events.parquet").select("user_id", F.minute("ts").alias("m")), ["user_id", "m"], [n()], "c", 10))
    _put("point_lookup", "SELECT user_id, event_id FROM events WHERE user_id = 42", lambda s, d: scan(s, f"{d}/events.parquet", ["event_id", "user_id"]).filter(F.col("user_id") == 42))
    _put("like_count", "SELECT count(*) AS c FROM pages WHERE url LIKE '%blog%'", lambda s, d: scan(s, f"{d}/pages.parquet", ["url"]).filter(F.col("url").like("%blog%")).agg(n()))
    _put("like_group_top", "SELECT lang, min(source) AS src, count(*) AS c FROM documents WHERE text LIKE '%MIT%' AND text NOT LIKE '%GPL%' GROUP BY lang ORDER BY c DESC, lang LIMIT 10", lambda s, d: group_top(scan(s, f"{d}/documents.parquet").filter(F.col("text").like("%MIT%") & ~F.col("text").like("%GPL%")), ["lang"], [F.min("source").alias("src"), n()], "c", 10))
    _put("sort_limit", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 10", lambda s, d: top_k(scan(s, f"{d}/events.parquet", ["event_id", "ts"]), [F.asc("ts"), F.asc("event_id")], 10))
    _put("sort_limit_offset", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 10 OFFSET 100", lambda s, d: top_k(scan(s, f"{d}/events.parquet", ["event_id", "ts"]), [F.asc("ts"), F.asc("event_id")], 10, 100))
    _put("having_length", "SELECT source, avg(length(text)) AS l, count(*) AS c FROM documents WHERE text <> '' GROUP BY source HAVING count(*) > 10 ORDER BY l DESC, source LIMIT 25", lambda s, d: top_k(scan(s, f"{d}/documents.parquet", ["source", "text"]).filter("text <> ''").groupBy("source").agg(F.avg(F.length("text")).alias("l"), n()).filter("c > 10"), [F.desc("l"), F.asc("source")], 25))
    _put("regexp_host_group", r"SELECT regexp_replace(url, '^https?://(?:www\.)?([^/?#]+)[/?#].*$', '\1') AS k, count(*) AS c, min(url) AS u FROM pages GROUP BY k ORDER BY c DESC, k LIMIT 25", lambda s, d: group_top(scan(s, f"{d}/pages.parquet", ["url"]).select(F.regexp_replace("url", r"^https?://(?:www\.)?([^/?#]+)[/?#].*$", "$1").alias("k"), "url"), ["k"], [n(), F.min("url").alias("u")], "c", 25))
    _put("sums_of_expressions", "SELECT " + ", ".join(f"CAST(sum(l_linenumber + {i}) AS BIGINT) AS s{i}" for i in range(90)) + " FROM lineitem", lambda s, d: aggregate(scan(s, f"{d}/lineitem.parquet", ["l_linenumber"]), [("sum", col("l_linenumber") + i, f"s{i}") for i in range(90)]))
    _put("case_group", "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS k, count(*) AS c FROM lineitem GROUP BY k", lambda s, d: scan(s, f"{d}/lineitem.parquet", ["l_quantity"]).groupBy(F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "middle").otherwise("large").alias("k")).agg(n()))
    _put("date_range_count", "SELECT event_type, count(*) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('click', 'view') GROUP BY event_type", lambda s, d: scan(s, f"{d}/events.parquet").filter("ts >= TIMESTAMP_NTZ'2024-01-10' AND ts < TIMESTAMP_NTZ'2024-01-20'").filter(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(n()))
    nations = lambda s, d: scan(s, f"{d}/nation.parquet", ["n_nationkey", "n_name", "n_regionkey"])
    customers = lambda s, d: scan(s, f"{d}/customer.parquet", ["c_custkey", "c_nationkey", "c_acctbal"])
    orders = lambda s, d: scan(s, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])
    _put("join_inner_group", "SELECT n_name, count(*) AS c, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", lambda s, d: join(customers(s, d), nations(s, d), [("c_nationkey", "n_nationkey")]).groupBy("n_name").agg(n(), F.round(F.sum("c_acctbal"), 2).alias("s")))
    _put("join_left", "SELECT c_custkey, count(o_orderkey) AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", lambda s, d: join(customers(s, d), orders(s, d), [("c_custkey", "o_custkey")], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("c")))
    _put("join_full", "SELECT count(*) AS c, count(s_suppkey) AS s, count(n_nationkey) AS k FROM (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) FULL JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey", lambda s, d: join(scan(s, f"{d}/supplier.parquet").where("s_suppkey % 3 = 0"), nations(s, d).where("n_nationkey % 2 = 0"), [("s_nationkey", "n_nationkey")], "full").agg(n(), F.count("s_suppkey").alias("s"), F.count("n_nationkey").alias("k")))
    for how, word in (("semi", "IN"), ("anti", "NOT IN")):
        _put(f"join_{how}", f"SELECT c_custkey FROM customer WHERE c_custkey {word} (SELECT o_custkey FROM orders)", lambda s, d, how=how: join(customers(s, d), orders(s, d), [("c_custkey", "o_custkey")], how).select("c_custkey"))
    _put("window_top_of_group", "SELECT c_nationkey, c_custkey, r FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS r FROM customer) WHERE r <= 3", lambda s, d: ranked(customers(s, d), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], "r", 3).select("c_nationkey", "c_custkey", "r"))
    _put("window_running", "SELECT event_id, count(*) OVER w AS c, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", lambda s, d: running(running(scan(s, f"{d}/events.parquet", ["event_id", "user_id", "ts", "value"]), ["user_id"], [F.asc("ts"), F.asc("event_id")], {"c": F.count(F.lit(1))}), ["user_id"], [F.asc("ts"), F.asc("event_id")], {"m": F.min("value")}, 3).select("event_id", "c", "m"))
    keys = lambda s, d: (scan(s, f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("k")), scan(s, f"{d}/customer.parquet").where("c_custkey < 40").select(F.col("c_nationkey").alias("k")))
    for name, f, distinct, sql in (("union_all", union, False, "UNION ALL"), ("union", union, True, "UNION"), ("intersect", intersect, True, "INTERSECT"), ("intersect_all", intersect, False, "INTERSECT ALL"), ("except", subtract, True, "EXCEPT"), ("except_all", subtract, False, "EXCEPT ALL")):
        _put(f"set_{name}", f"SELECT s_nationkey AS k FROM supplier {sql} SELECT c_nationkey AS k FROM customer WHERE c_custkey < 40", lambda s, d, f=f, distinct=distinct: f(*keys(s, d), distinct))
    _put("user_function", "SELECT l_orderkey, l_quantity * 2 + 1 AS v FROM lineitem", lambda s, d: scan(s, f"{d}/lineitem.parquet").select("l_orderkey", register_scalar(s, "twice_and_one", _twice_and_one, "double")("l_quantity").alias("v")))
    _put("user_aggregate", "SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS v FROM lineitem GROUP BY l_returnflag", lambda s, d: scan(s, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(register_aggregate(s, "spread", _spread, "double")("l_quantity").alias("v")))
    _put("date_trunc_group", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, count(*) AS c FROM events GROUP BY h", lambda s, d: scan(s, f"{d}/events.parquet", ["ts"]).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("h")).agg(n()))


def _shared(spark: SparkSession, label: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = os.path.join(tempfile.gettempdir(), f"marlstone-{os.getuid()}")
    return os.path.join(root if urlparse(root).scheme else os.path.abspath(root), f"{label}-{uuid.uuid4().hex}")


def column_file_round_trip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write a small table as one legacy column file and read it back. The file is written by the driver, so the session's shared folder must be a mounted path."""
    path = urlparse(_shared(spark, "columns")).path
    os.makedirs(os.path.dirname(path), exist_ok=True)
    write_column_file(df, path, 10)
    return read_column_file(spark, path)


def csv_round_trip(spark: SparkSession, df: DataFrame, **form) -> DataFrame:
    """Write as CSV into the session's shared folder and read back; microseconds are kept. NULLs have no CSV form here: strings come back empty."""
    path = _shared(spark, "csv")
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    write_csv(df, path, timestamp_format=micros, **form)
    return read_csv(spark, path, df.schema, timestamp_format=micros, **form)


def converted(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table to CSV, with a schema file beside it to the store, and from there to CSV once more."""
    first, schema, store, second = (_shared(spark, x) for x in ("csv", "schema", "store", "csv"))
    write_csv(df, first)
    lines = "\n".join(f"{f.name},{to_logical_name(f.dataType)}" for f in df.schema.fields)
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(schema)
    csv_to_store(spark, first, schema, store)
    store_to_csv(spark, store, second)
    return read_csv(spark, second, load_schema(spark, schema))


def exported(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One column as CSV, read back strictly."""
    export_column(spark, path, name, out := _shared(spark, "column"))
    return read_csv(spark, out, scan(spark, path, [name]).schema)


def streamed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A CSV folder as a stream into the store."""
    folder, store, progress = (_shared(spark, x) for x in ("csv", "store", "progress"))
    write_csv(df, folder)
    stream_to_store(csv_stream(spark, folder, df.schema), store, progress).awaitTermination()
    return spark.read.schema(df.schema).parquet(store)


def stream_counted(spark: SparkSession, path: str) -> DataFrame:
    """Hourly counts kept current by a stream; each trigger replaces the stored result."""
    source, store, progress = (_shared(spark, x) for x in ("stream", "store", "progress"))
    events = scan(spark, path, ["ts", "event_type"])
    events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(source)
    counts = windowed_counts(stream, "ts", "1 hour", "1 hour", ["event_type"])
    counts.writeStream.outputMode("complete").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(store)).start().awaitTermination()
    return spark.read.parquet(store).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def _twice_and_one(x: pd.Series) -> pd.Series:
    return x * 2 + 1


def _spread(x: pd.Series) -> float:
    return x.max() - x.min()


_fill()
