import datetime as dt

import duckdb
import pytest

from marlstone.plans.canned import SQL, TREES, run_on, run_query

#: A table of 130,000 rows, made by arithmetic on the row number, in which every canned query finds rows.
ROWS = 130_000
HITS = """
SELECT id AS WatchID, CASE WHEN id % 997 = 0 THEN 435090932899640449 ELSE id % 5003 END AS UserID,
  CASE WHEN id % 2 = 0 THEN 2868770270353813622 ELSE id % 401 END AS URLHash, 3594120000172545465 AS RefererHash,
  CAST(CASE WHEN id % 10 = 9 THEN id % 7 ELSE 62 END AS INT) AS CounterID, CAST(id % 311 - 100 AS INT) AS ClientIP, CAST(id % 229 AS INT) AS RegionID,
  CAST(CASE WHEN id % 4 = 1 THEN id % 19 ELSE 0 END AS SMALLINT) AS AdvEngineID, CAST(id % 1900 AS SMALLINT) AS ResolutionWidth, CAST(id % 3 AS SMALLINT) AS SearchEngineID,
  CAST(id % 6 AS SMALLINT) AS MobilePhone, CAST(CASE WHEN id % 3 = 0 THEN -1 WHEN id % 3 = 1 THEN 6 ELSE 2 END AS SMALLINT) AS TraficSourceID,
  CAST(CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS IsRefresh, CAST(id % 2 AS SMALLINT) AS IsLink, CAST(CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS IsDownload,
  CAST(CASE WHEN id % 23 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS DontCountHits, CAST(id % 1009 AS SMALLINT) AS WindowClientWidth, CAST(id % 613 AS SMALLINT) AS WindowClientHeight,
  CASE WHEN id % 3 = 0 THEN '' ELSE concat('phrase ', CAST(id % 97 AS STRING)) END AS SearchPhrase, CASE WHEN id % 5 = 0 THEN concat('model ', CAST(id % 41 AS STRING)) ELSE '' END AS MobilePhoneModel,
  CASE WHEN id % 29 = 0 THEN concat('http://www.google.example/', CAST(id % 59 AS STRING)) WHEN id % 31 = 0 THEN '' ELSE concat('https://site.example/page/', CAST(id % 4001 AS STRING)) END AS URL,
  CASE WHEN id % 11 = 0 THEN concat('Google page ', CAST(id % 83 AS STRING)) WHEN id % 37 = 0 THEN '' ELSE concat('Title ', CAST(id % 71 AS STRING)) END AS Title,
  CASE WHEN id % 19 = 0 THEN '' ELSE concat('https://www.refers.example/', CAST(id % 503 AS STRING), '/x') END AS Referer,
  {stamp} AS EventTime, {day} AS EventDate
FROM {source}
"""
SPARK = {"stamp": "CAST(timestamp_seconds(1372680000 + id * 19) AS TIMESTAMP_NTZ)", "day": "CAST(timestamp_seconds(1372680000 + id * 19) AS DATE)", "source": f"range({ROWS})"}
DUCK = {"stamp": "make_timestamp((1372680000 + id * 19) * 1000000)", "day": "CAST(make_timestamp((1372680000 + id * 19) * 1000000) AS DATE)", "source": f"(SELECT range AS id FROM range({ROWS}))"}


@pytest.fixture(scope="module")
def hits(spark):
    return spark.sql(HITS.format(**SPARK)).cache()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.execute(f"CREATE TABLE hits AS {HITS.format(**DUCK)}")
    return con


TREE_SQL = (
    "SELECT count(*) FROM hits", "SELECT count(*) FROM hits WHERE AdvEngineID <> 0", "SELECT sum(AdvEngineID), count(*), avg(ResolutionWidth) FROM hits", "SELECT avg(UserID) FROM hits",
    "SELECT count(DISTINCT UserID) FROM hits", "SELECT count(DISTINCT SearchPhrase) FROM hits", "SELECT min(EventDate), max(EventDate) FROM hits",
)


def cells(row):
    plain = lambda v: v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
    return tuple(pytest.approx(float(v), rel=1e-9) if isinstance(v, (int, float)) else plain(v) for v in row)


def test_trees(spark, hits, other, tmp_path):
    hits.write.parquet(path := str(tmp_path / "h"))
    for n in sorted(TREES):
        assert cells(run_query(spark, n, path).first()) == tuple(float(v) if not isinstance(v, dt.date) else v for v in other.execute(TREE_SQL[n]).fetchone())


@pytest.mark.parametrize("n", sorted(SQL))
def test_benchmark_queries_against_another_engine(spark, hits, other, n):
    sql = SQL[n].replace("{hits}", "hits").replace("\\\\.", "\\.").replace("'$1'", "'\\1'")
    got, want = [tuple(r) for r in run_on(spark, n, hits).collect()], other.execute(sql).fetchall()
    assert want and len(got) == len(want)
    if n == 24:  # ties in time have no order
        got, want = sorted(got), sorted(want)
    for a, b in zip(got, want, strict=True):
        assert cells(a) == tuple(float(v) if not isinstance(v, (str, dt.date)) else v for v in b)


def test_unknown_number(spark, hits):
    with pytest.raises(ValueError):
        run_on(spark, 43, hits)
