import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import url_filter as U


def brute(url, rules, hosts):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    plain = any(host == h or host.endswith("." + h) for h in hosts)
    return host, path, best[0] if best else None, best[1] if best else "block" if plain else "allow"


def test_against_brute_force(spark):
    pick = random.Random(3)
    urls = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/EN/x", "http://example.net", "http://example.net/en", "http://notexample.net/en/", "a://b://example.org/fr/", "http://x.net?/en/", "http://x.net#/", "http://x.org/fr/\n?q", "http://a.b.c.d.e.f.example.com/de/1", "http://net/", "x://spam-farm.example.org", "x://www.casino-win.example.org/a"]
    urls += [f"http://{pick.choice(['www.', '', 'm.a.'])}{pick.choice(['example', 'other', 'free-bets.example'])}.{pick.choice(['net', 'org', 'com', 'xnet'])}/{pick.choice(['en/', 'de/', 'fr/', 'fr', ''])}{pick.choice(['', '1?x', '#y'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df).collect()}
    assert got == {i: brute(u, U.RULES, U.BLOCKED_HOSTS) for i, u in enumerate(urls)}


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(df).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert U.judge(one, (), ()).first().verdict == "allow"


def keys_table(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string").withColumn("h", F.xxhash64("key"))


def listed_in(cascade, rows):
    return {rows[i].key for i in cascade.has(np.array([r.h for r in rows], np.int64), [r.key for r in rows])}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.example/" for i in range(20000)]
    universe, listed = keys_table(spark, keys), [*keys[::40], "not in the corpus"]
    cascade = U.build_cascade(universe, keys_table(spark, listed))
    assert listed_in(cascade, universe.collect()) == set(keys[::40])
    assert len(cascade.levels) > 1 and sum(level.bits for level in cascade.levels) < 64 * 1000


def test_equal_hashes_are_decided_by_the_key(spark):
    keys = [f"k{i}" for i in range(300)]
    same = lambda ks: keys_table(spark, ks).withColumn("h", F.when(F.col("key").isin("k7", "k8"), F.lit(5).cast("long")).otherwise(F.col("h")))
    cascade = U.build_cascade(same(keys), same(["k7", "k9", "k200"]))
    assert listed_in(cascade, same(keys).collect()) == {"k7", "k9", "k200"}


def test_long_lists_come_as_tables(spark):
    hosts = spark.range(200_000).selectExpr("concat('bad', id, '.example') as host")
    rules = spark.createDataFrame([("example/ok/", "allow"), ("example/ok/", "allow"), (None, "block"), ("bad3.example/", "allow"), ("bad3.example/", "block")], "rule string, verdict string")
    urls = [*(f"http://www.bad{i}.example/x" for i in range(0, 400_000, 1000)), "http://bad4000.example/ok/1", "http://bad3.example/ok/1", "http://bad3.example/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.url: (r.rule, r.verdict) for r in U.judge(df, rules, hosts).collect()}
    assert got == {u: ("example/ok/", "allow") if u == "http://bad4000.example/ok/1" else ("bad3.example/", "block") if "//bad3." in u else (None, "block" if int(u[14:].split(".")[0]) < 200_000 else "allow") for u in urls}


def test_very_long_urls(spark):
    urls = ["http://" + "a" * 1_000_000 + ".net/" + "p" * 20_000_000, "http://" + "b." * 200_000 + "org/fr/x", "x" * 20_000_000]
    rows = {r.page_id: (len(r.host), len(r.path), r.rule) for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    assert rows == {0: (1_000_004, 20_000_001, "net/"), 1: (400_003, 5, "org/fr/"), 2: (0, 0, None)}
