"""URL filters by a cascade of Bloom filters.

A rule is a host, a path prefix and a verdict; it fits the host and its subdomains where the url's path starts with the prefix. Looked up
are *keys*, a host suffix followed by a path prefix (``example.net/en/``): a url has one key for each suffix of at most as many labels as
any rule's host and each prefix length that rules have. For each outcome (block rule, allow rule, plainly blocked host), level 0 of a cascade encodes the listed keys, level 1 those other
keys of the corpus's whole key universe that level 0 lets through, level 2 the listed keys that level 1 lets through, and so on until
nothing passes wrongly. Membership is the parity of the level that first says no, exact for every key of the universe, with no join of the pages and with filters
whose size follows the rules and, by a logarithm, the universe: some ``1.44 * (log2(universe / rules) + 3)`` bits a rule. The universe is one distributed ``distinct``; only what passes level 0 is joined with the list to learn what passed wrongly.

Rules and hosts are tables of any length or, for short lists, Python sequences; nothing but filters is broadcast. A url that is null or has no ``://`` has an empty host and path and fits no rule. Without a rule a url gets the verdict ``block`` if its
host is on the plain list of blocked hosts (or a subdomain of one), else ``allow``. Repeated rules count
once; a key under both verdicts blocks; null rules and hosts are ignored. An empty table gives no rows. Extra columns are kept by ``judge``, except those it adds. A very long url costs as many keys as any other; its host and path are returned whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import forget, prepare, stored

#: The contract's rules, and registered hosts blocked with all their subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCKED_HOSTS = ("ads-track.example.org", "casino-win.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org")

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Bloom:
    """A Bloom filter of 64-bit keys; ``level`` seeds its hashes."""

    bits: int
    hashes: int
    level: int
    words: np.ndarray | None = None

    @classmethod
    def sized(cls, n: int, rate: float, level: int) -> Bloom:
        hashes = max(1, round(-math.log2(rate)))
        return cls(64 * max(1, math.ceil(1.4427 * hashes * max(n, 1) / 64)), hashes, level)

    def positions(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a = _mix(keys.view(np.uint64) + np.uint64(2 * self.level + 1) * _GOLDEN)
            b = _mix(a ^ _GOLDEN) | np.uint64(1)
            return (a[:, None] + b[:, None] * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.bits)

    def add(self, words: np.ndarray) -> Bloom:
        self.words = words
        return self

    def has(self, keys: np.ndarray) -> np.ndarray:
        p = self.positions(keys)
        return ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)
    #: Hashes that a listed and another key share, and the listed keys with such a hash: empty but for collisions of 64 bits, which are decided by the key itself.
    shared: frozenset[int] = frozenset()
    collisions: frozenset[str] = frozenset()

    def passed(self, keys: np.ndarray) -> np.ndarray:
        """How many levels in a row let each key through."""
        out = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for level in self.levels:
            open_ = open_[level.has(keys[open_])]
            out[open_] += 1
            if not len(open_):
                break
        return out

    def has(self, keys: np.ndarray, names: Sequence[str]) -> np.ndarray:
        """Which keys, given by hash and name, are listed: their places."""
        found = np.flatnonzero(self.passed(keys) % 2 == 1)
        if self.shared:
            alike = np.flatnonzero(np.isin(keys, list(self.shared)))
            found = np.union1d(np.setdiff1d(found, alike), np.array([i for i in alike if names[i] in self.collisions], np.int64))
        return found


def _passing(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """Rows of (key, h, listed) on which all levels so far say yes."""
    shared = keys.sparkSession.sparkContext.broadcast(cascade)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.passed(b.column("h").to_numpy()) == len(shared.value.levels)))

    return keys.mapInArrow(kept, keys.schema)


def _filled(keys: DataFrame, bloom: Bloom) -> Bloom:
    """Set the bits of ``keys``: positions on the executors, words combined by a partial ``bit_or``; the driver gets the filter's words."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(bloom.positions(b.column("h").to_numpy()))
            words, start = np.unique(p >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), start) if len(p) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = keys.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(bloom.bits // 64, np.uint64)
    words[rows.word.to_numpy(np.int64)] = rows.bits.to_numpy(np.int64).view(np.uint64)
    return bloom.add(words)


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """``universe``: distinct (key, h), ``listed``: distinct (key, h)."""
    n, others = listed.count(), universe.count()
    cascade = Cascade()
    if not n:
        return cascade
    cascade.levels.append(_filled(listed, Bloom.sized(n, min(0.5, n * math.sqrt(0.5) / max(others, 1)), 0)))
    # what passes the first level is the listed keys and a few others: only these are told apart by a join
    few = _passing(universe, cascade).join(listed.select("key", F.lit(True).alias("yes")), "key", "left").select("key", "h", F.col("yes").isNotNull().alias("listed"))
    sides, side = stored(few, "url-sides"), False
    while True:
        now = stored(_passing(sides.where(F.col("listed") == side), cascade), "url-passing")
        to_encode = now.count()
        if to_encode and len(cascade.levels) >= 64:  # equal hashes never part
            both = _passing(sides, cascade)
            same = both.groupBy("h").agg(F.count_distinct("listed").alias("k")).where("k > 1").select("h")
            cascade.shared = frozenset(r.h for r in same.collect())
            cascade.collisions = frozenset(r.key for r in both.where("listed").join(same, "h", "left_semi").collect())
            to_encode = 0
        if to_encode:
            cascade.levels.append(_filled(now, Bloom.sized(to_encode, 0.5, len(cascade.levels))))
        forget(now)
        if not to_encode:
            forget(sides)
            return cascade
        side = not side


def rules_table(spark: SparkSession, rules: DataFrame | Sequence[tuple[str, str]], hosts: DataFrame | Sequence[str]) -> DataFrame:
    """Distinct (key, h, kind) of rules (rule, verdict) and hosts (host); kind is block, allow or host."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "rule string, verdict string")
    if not isinstance(hosts, DataFrame):
        hosts = spark.createDataFrame([(h,) for h in hosts], "host string")
    named = rules.groupBy(F.col("rule").alias("key")).agg(F.max("verdict").alias("kind"))  # block, if under both
    return named.unionByName(hosts.select(F.col("host").alias("key"), F.lit("host").alias("kind")).distinct()).where("key is not null").select("key", F.xxhash64("key").alias("h"), "kind")


def with_keys(pages: DataFrame, labels: int, lengths: Sequence[int]) -> DataFrame:
    """``pages`` with host, path and the array of keys."""
    lower = F.translate(F.regexp_extract("url", r"(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.coalesce(lower, F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    out = pages.withColumns({"host": host, "path": path})
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)))
    starts = F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    return out.withColumn("keys", F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))))


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str]] = RULES, hosts: DataFrame | Sequence[str] = BLOCKED_HOSTS) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    spark = pages.sparkSession
    prepare(spark)
    listed = stored(rules_table(spark, rules, hosts), "url-rules")
    head = F.substring_index("key", "/", 1)
    widths = listed.select((F.length(head) - F.length(F.translate(head, ".", "")) + 1).alias("labels"), (F.length("key") - F.length(head)).alias("length")).distinct().collect()  # no more than pairs of two small numbers
    keyed = with_keys(pages.drop("host", "path", "keys", "hashes", "rule", "verdict"), max([1, *(r.labels for r in widths)]), sorted({0, *(r.length for r in widths)}))
    universe = stored(keyed.select(F.explode("keys").alias("key")).distinct().withColumn("h", F.xxhash64("key")), "url-keys")
    kinds = ("block", "allow", "host")
    shared = spark.sparkContext.broadcast({k: build_cascade(universe, listed.where(F.col("kind") == k).select("key", "h")) for k in kinds})  # filters: a few bytes a rule
    forget(universe)
    forget(listed)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys").flatten().to_pylist()
            h = np.asarray(b.column("hashes").flatten().to_numpy(zero_copy_only=False), np.int64)
            counts = np.asarray(pc.list_value_length(b.column("keys")).to_numpy(zero_copy_only=False), np.int64)
            row = np.repeat(np.arange(b.num_rows), counts)
            best: dict[int, tuple[int, str, str]] = {}
            for kind in ("block", "allow"):
                for i in shared.value[kind].has(h, keys).tolist():
                    best[int(row[i])] = max(best.get(int(row[i]), (-1, "", "")), (len(keys[i]), keys[i], kind))
            blocked = {int(row[i]) for i in shared.value["host"].has(h, keys)}
            rule = [best[i][1] if i in best else None for i in range(b.num_rows)]
            verdict = [best[i][2] if i in best else "block" if i in blocked else "allow" for i in range(b.num_rows)]
            kept = b.select([n for n in b.schema.names if n not in ("keys", "hashes")])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=kept.schema.append(pa.field("rule", pa.string())).append(pa.field("verdict", pa.string())))

    hashed = keyed.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    return hashed.mapInArrow(judged, keyed.drop("keys").schema.add("rule", "string").add("verdict", "string"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def oracle(rules: Sequence[tuple[str, str]] = RULES, hosts: Sequence[str] = BLOCKED_HOSTS) -> str:
    table = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules)
    plain = " OR ".join(f"'.' || host LIKE '%.{h}'" for h in hosts)
    return f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(rule, rh, rp, v) AS (VALUES {table}),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM p JOIN r ON ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, f.rule, coalesce(v, CASE WHEN {plain} THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN f USING (page_id)"""
