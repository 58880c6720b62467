"""Canned queries over a ``hits``-shaped table, by number: 0 to 6 as expression trees, 7 to 42 as SQL of the public web-analytics benchmark.

All read only the columns they name. Queries with LIMIT order by their keys as well, so that ties do not make the result undetermined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.functions.expressions import col, compare, lit
from marlstone.operators.aggregate import aggregate
from marlstone.operators.relational import filter_rows, scan

_JULY = "CounterID = 62 AND EventDate >= DATE'2013-07-01' AND EventDate <= DATE'2013-07-31'"

SQL: dict[int, str] = {
    7: "SELECT AdvEngineID, COUNT(*) AS c FROM {hits} WHERE AdvEngineID <> 0 GROUP BY AdvEngineID ORDER BY c DESC, AdvEngineID",
    8: "SELECT RegionID, COUNT(DISTINCT UserID) AS u FROM {hits} GROUP BY RegionID ORDER BY u DESC, RegionID LIMIT 10",
    9: "SELECT RegionID, SUM(AdvEngineID) AS s, COUNT(*) AS c, AVG(ResolutionWidth) AS a, COUNT(DISTINCT UserID) AS u FROM {hits} GROUP BY RegionID ORDER BY c DESC, RegionID LIMIT 10",
    10: "SELECT MobilePhoneModel, COUNT(DISTINCT UserID) AS u FROM {hits} WHERE MobilePhoneModel <> '' GROUP BY MobilePhoneModel ORDER BY u DESC, MobilePhoneModel LIMIT 10",
    11: "SELECT MobilePhone, MobilePhoneModel, COUNT(DISTINCT UserID) AS u FROM {hits} WHERE MobilePhoneModel <> '' GROUP BY MobilePhone, MobilePhoneModel ORDER BY u DESC, MobilePhone, MobilePhoneModel LIMIT 10",
    12: "SELECT SearchPhrase, COUNT(*) AS c FROM {hits} WHERE SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10",
    13: "SELECT SearchPhrase, COUNT(DISTINCT UserID) AS u FROM {hits} WHERE SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY u DESC, SearchPhrase LIMIT 10",
    14: "SELECT SearchEngineID, SearchPhrase, COUNT(*) AS c FROM {hits} WHERE SearchPhrase <> '' GROUP BY SearchEngineID, SearchPhrase ORDER BY c DESC, SearchEngineID, SearchPhrase LIMIT 10",
    15: "SELECT UserID, COUNT(*) AS c FROM {hits} GROUP BY UserID ORDER BY c DESC, UserID LIMIT 10",
    16: "SELECT UserID, SearchPhrase, COUNT(*) AS c FROM {hits} GROUP BY UserID, SearchPhrase ORDER BY c DESC, UserID, SearchPhrase LIMIT 10",
    17: "SELECT UserID, SearchPhrase, COUNT(*) AS c FROM {hits} GROUP BY UserID, SearchPhrase ORDER BY UserID, SearchPhrase LIMIT 10",
    18: "SELECT UserID, minute(EventTime) AS m, SearchPhrase, COUNT(*) AS c FROM {hits} GROUP BY UserID, m, SearchPhrase ORDER BY c DESC, UserID, m, SearchPhrase LIMIT 10",
    19: "SELECT UserID FROM {hits} WHERE UserID = 435090932899640449",
    20: "SELECT COUNT(*) AS c FROM {hits} WHERE URL LIKE '%google%'",
    21: "SELECT SearchPhrase, MIN(URL) AS url, COUNT(*) AS c FROM {hits} WHERE URL LIKE '%google%' AND SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10",
    22: "SELECT SearchPhrase, MIN(URL) AS url, MIN(Title) AS title, COUNT(*) AS c, COUNT(DISTINCT UserID) AS u FROM {hits} WHERE Title LIKE '%Google%' AND URL NOT LIKE '%.google.%' AND SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10",
    23: "SELECT * FROM {hits} WHERE URL LIKE '%google%' ORDER BY EventTime, WatchID LIMIT 10",
    24: "SELECT SearchPhrase FROM {hits} WHERE SearchPhrase <> '' ORDER BY EventTime, SearchPhrase LIMIT 10",
    25: "SELECT SearchPhrase FROM {hits} WHERE SearchPhrase <> '' ORDER BY SearchPhrase LIMIT 10",
    26: "SELECT SearchPhrase FROM {hits} WHERE SearchPhrase <> '' ORDER BY EventTime, SearchPhrase, WatchID LIMIT 10",
    27: "SELECT CounterID, AVG(length(URL)) AS l, COUNT(*) AS c FROM {hits} WHERE URL <> '' GROUP BY CounterID HAVING COUNT(*) > 100000 ORDER BY l DESC, CounterID LIMIT 25",
    28: "SELECT regexp_replace(Referer, '^https?://(?:www\\\\.)?([^/]+)/.*$', '$1') AS k, AVG(length(Referer)) AS l, COUNT(*) AS c, MIN(Referer) AS r FROM {hits} WHERE Referer <> '' GROUP BY k HAVING COUNT(*) > 100000 ORDER BY l DESC, k LIMIT 25",
    29: "SELECT " + ", ".join(f"SUM(ResolutionWidth + {n}) AS s{n}" for n in range(90)) + " FROM {hits}",
    30: "SELECT SearchEngineID, ClientIP, COUNT(*) AS c, SUM(IsRefresh) AS r, AVG(ResolutionWidth) AS a FROM {hits} WHERE SearchPhrase <> '' GROUP BY SearchEngineID, ClientIP ORDER BY c DESC, SearchEngineID, ClientIP LIMIT 10",
    31: "SELECT WatchID, ClientIP, COUNT(*) AS c, SUM(IsRefresh) AS r, AVG(ResolutionWidth) AS a FROM {hits} WHERE SearchPhrase <> '' GROUP BY WatchID, ClientIP ORDER BY c DESC, WatchID, ClientIP LIMIT 10",
    32: "SELECT WatchID, ClientIP, COUNT(*) AS c, SUM(IsRefresh) AS r, AVG(ResolutionWidth) AS a FROM {hits} GROUP BY WatchID, ClientIP ORDER BY c DESC, WatchID, ClientIP LIMIT 10",
    33: "SELECT URL, COUNT(*) AS c FROM {hits} GROUP BY URL ORDER BY c DESC, URL LIMIT 10",
    34: "SELECT 1 AS one, URL, COUNT(*) AS c FROM {hits} GROUP BY URL ORDER BY c DESC, URL LIMIT 10",
    35: "SELECT ClientIP, ClientIP - 1 AS a, ClientIP - 2 AS b, ClientIP - 3 AS d, COUNT(*) AS c FROM {hits} GROUP BY ClientIP ORDER BY c DESC, ClientIP LIMIT 10",
    36: f"SELECT URL, COUNT(*) AS v FROM {{hits}} WHERE {_JULY} AND DontCountHits = 0 AND IsRefresh = 0 AND URL <> '' GROUP BY URL ORDER BY v DESC, URL LIMIT 10",
    37: f"SELECT Title, COUNT(*) AS v FROM {{hits}} WHERE {_JULY} AND DontCountHits = 0 AND IsRefresh = 0 AND Title <> '' GROUP BY Title ORDER BY v DESC, Title LIMIT 10",
    38: f"SELECT URL, COUNT(*) AS v FROM {{hits}} WHERE {_JULY} AND IsRefresh = 0 AND IsLink <> 0 AND IsDownload = 0 GROUP BY URL ORDER BY v DESC, URL LIMIT 10 OFFSET 1000",
    39: f"SELECT TraficSourceID, SearchEngineID, AdvEngineID, CASE WHEN SearchEngineID = 0 AND AdvEngineID = 0 THEN Referer ELSE '' END AS src, URL AS dst, COUNT(*) AS v FROM {{hits}} WHERE {_JULY} AND IsRefresh = 0 GROUP BY TraficSourceID, SearchEngineID, AdvEngineID, src, dst ORDER BY v DESC, TraficSourceID, SearchEngineID, AdvEngineID, src, dst LIMIT 10 OFFSET 1000",
    40: f"SELECT URLHash, EventDate, COUNT(*) AS v FROM {{hits}} WHERE {_JULY} AND IsRefresh = 0 AND TraficSourceID IN (-1, 6) AND RefererHash = 3594120000172545465 GROUP BY URLHash, EventDate ORDER BY v DESC, URLHash, EventDate LIMIT 10 OFFSET 100",
    41: f"SELECT WindowClientWidth, WindowClientHeight, COUNT(*) AS v FROM {{hits}} WHERE {_JULY} AND IsRefresh = 0 AND DontCountHits = 0 AND URLHash = 2868770270353813622 GROUP BY WindowClientWidth, WindowClientHeight ORDER BY v DESC, WindowClientWidth, WindowClientHeight LIMIT 10 OFFSET 10000",
    42: "SELECT date_trunc('minute', EventTime) AS m, COUNT(*) AS v FROM {hits} WHERE CounterID = 62 AND EventDate >= DATE'2013-07-14' AND EventDate <= DATE'2013-07-15' AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY m ORDER BY m LIMIT 10 OFFSET 1000",
}


def count_rows(hits: DataFrame) -> DataFrame:
    return aggregate(hits, [("count", lit(1), "c")])


def count_adverts(hits: DataFrame) -> DataFrame:
    return count_rows(filter_rows(hits, compare(hits, col("AdvEngineID"), "<>", lit(0, "int16"))))


def three_aggregates(hits: DataFrame) -> DataFrame:
    return aggregate(hits, [("sum", col("AdvEngineID"), "s"), ("count", lit(1), "c"), ("avg", col("ResolutionWidth"), "a")])


#: Columns scanned by each tree, and the tree.
TREES: dict[int, tuple[list[str], Callable[[DataFrame], DataFrame]]] = {
    0: (["AdvEngineID"], count_rows),
    1: (["AdvEngineID"], count_adverts),
    2: (["AdvEngineID", "ResolutionWidth"], three_aggregates),
    3: (["UserID"], lambda hits: aggregate(hits, [("avg", col("UserID"), "a")])),
    4: (["UserID"], lambda hits: aggregate(hits, [("count_distinct", col("UserID"), "c")])),
    5: (["SearchPhrase"], lambda hits: aggregate(hits, [("count_distinct", col("SearchPhrase"), "c")])),
    6: (["EventDate"], lambda hits: aggregate(hits, [("min", col("EventDate"), "mn"), ("max", col("EventDate"), "mx")])),
}


def run_on(spark: SparkSession, n: int, hits: DataFrame) -> DataFrame:
    if n in TREES:
        return TREES[n][1](hits)
    if n in SQL:
        return spark.sql(SQL[n], hits=hits)
    raise ValueError(f"no canned query {n}; 0 to {max(SQL)} exist")


def run_query(spark: SparkSession, n: int, path: str) -> DataFrame:
    """Canned query ``n`` over the Parquet table at ``path``; an unknown number raises."""
    return run_on(spark, n, scan(spark, path, TREES[n][0] if n in TREES else ()))
