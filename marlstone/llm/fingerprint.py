"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing splits a text into phrases: equal neighbours join to one symbol, each symbol is labelled by the lowest bit in which it differs from its left neighbour, which three rounds
bring to labels below 8, and phrases begin where labels peak. Where a phrase begins depends on a handful of neighbours only, so that equal substrings have the same phrases inside,
whatever their offset. A phrase is named by a hash of what it is made of, and the names are parsed again. A fingerprint holds the least ``KEEP`` hashes of the distinct names at levels 1 and 2 (phrases of about 4
and 14 characters); the share of common names among the least of two fingerprints estimates the Jaccard likeness of the texts' phrases, at level 2 where both have ``ENOUGH`` of them, else
at level 1.

Equal texts have equal fingerprints and likeness 1; a null text counts as empty, whose fingerprint is ``-``. Documents with equal ids are taken in the order of their texts' hashes, equal rows one after another, null ids come
last. A table's only document is its own next one; an empty table gives no rows; columns other than doc_id and text are ignored. A very long text is parsed whole, in some 50 bytes of a task's memory for each character.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import prepare, stored, text_of

KEEP, ENOUGH = (16, 64), 8
#: Characters parsed together.
CHUNK = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST = -(2**63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8, different for neighbours."""
    label = names
    for _ in range(3):
        differ = np.empty_like(label)
        differ[1:] = label[1:] ^ label[:-1]
        differ[first] = np.uint64(1)
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        label = low << np.uint64(1) | ((label >> low) & np.uint64(1))
    return label.astype(np.int8)


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of texts laid end to end: their names and which begin a text. ``first``: places where texts begin; none is empty."""
    n = len(symbols)
    new = np.empty(n, bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    length = np.diff(at, append=n)
    names = symbols[at]
    long = np.flatnonzero(length > 1)
    names[long] = _mix(names[long] * _BASE + length[long].astype(np.uint64))
    first = np.searchsorted(at, first)
    label = _tossed(names, first)
    following = np.append(label[1:], np.int8(-1))
    following[first[1:] - 1] = -1  # nothing of the next text
    peak = label > following
    peak[1:] &= label[1:] > label[:-1]
    peak[first] = True
    starts = np.flatnonzero(peak)
    size = np.diff(starts, append=len(names))
    rank = np.arange(len(names)) - np.repeat(starts, size)
    powers = np.cumprod(np.full(int(size.max()), _BASE))
    return _mix(np.add.reduceat(names * powers[rank], starts)), np.searchsorted(starts, first)


def signatures(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The least hashes of each text's names at each level."""
    full = [i for i, t in enumerate(texts) if t]
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] * len(KEEP) for _ in texts]
    if full:
        symbols = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum([0, *(len(texts[i]) for i in full[:-1])])
        for level, keep in enumerate(KEEP):
            symbols, first = parse(symbols, first)
            owner = np.repeat(np.arange(len(full)), np.diff(first, append=len(symbols)))
            each = np.unique(owner.astype(np.uint64) << np.uint64(32) | (symbols >> np.uint64(32)))
            of = (each >> np.uint64(32)).astype(np.int64)
            begin = np.searchsorted(of, np.arange(len(full) + 1))
            values = each.astype(np.uint32)
            for j, i in enumerate(full):
                out[i][level] = values[begin[j] : min(begin[j + 1], begin[j] + keep)]
    return [tuple(x) for x in out]


def as_text(signature: tuple[np.ndarray, np.ndarray]) -> str:
    return "-".join(a.astype(">u4").tobytes().hex() for a in signature)


def from_text(text: str) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in text.split("-"))


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Estimated Jaccard likeness of two texts, from their signatures alone."""
    level = 1 if min(len(a[1]), len(b[1])) >= ENOUGH else 0
    x, y = a[level], b[level]
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate([x, y])
    both.sort()
    again = both[1:] == both[:-1]
    union = np.append(~again, True)
    n = int(union.sum())
    if max(len(x), len(y)) == KEEP[level]:  # one is cut off: only the least of the union are sure
        n = min(n, KEEP[level])
    last = both[union][n - 1]
    return float(np.count_nonzero(again & (both[1:] <= last)) / n)


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the next document."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, key, hash, text, n): distinct documents and how many rows are equal to each. Only where ids repeat do rows have to be brought together for it; equal ones combine before the shuffle."""
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), text_of().alias("text"))
    if keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return keyed.select("doc_id", "key", F.lit(0).cast("long").alias("hash"), "text", F.lit(1).cast("long").alias("n"))
    hashed = keyed.withColumn("hash", F.xxhash64("text"))
    return stored(hashed.groupBy("key", "hash").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n")).select("doc_id", "key", "hash", "text", "n"), "fingerprint-rows")


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text, n) so that a sorted bucket holds runs of documents by descending id (equal ids by hash), and after each run the document that follows it. n: rows that the document stands for."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _numbered(docs)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = max((max(zip(b.column("key").to_pylist(), b.column("turn").to_pylist(), strict=True)) for b in batches if b.num_rows), default=None)
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array([top[0]], pa.int64()), pa.array([top[1]], pa.int64())], names=["key", "turn"])

    rows = rows.withColumn("turn", F.bitwise_not("hash"))  # descending by turn is ascending by hash
    each = rows.select("key", "turn").repartitionByRange(parts, "key", "turn").mapInArrow(largest, "key long, turn long")
    bounds = sorted({(r.key, r.turn) for r in each.collect()})  # one for each partition
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("array<int>")
    def buckets(key: pd.Series, turn: pd.Series) -> pd.Series:
        out = []
        for at in zip(key.tolist(), turn.tolist(), strict=True):
            i = bisect_left(shared.value, at)
            out.append([i, (i + 1) % len(shared.value)] if shared.value[i] == at else [i])
        return pd.Series(out)

    dealt = rows.select("doc_id", "key", "turn", "text", "n", F.posexplode(buckets("key", "turn")).alias("extra", "bucket"))
    return dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc("key"), F.desc("turn")).select("bucket", "extra", "doc_id", "text", "n")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    prepare(docs.sparkSession)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        now, held, closed = None, None, False
        for b in batches:
            for bucket, extra, doc, text, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text", "n")), strict=True):
                if bucket != now:
                    now, held, closed = bucket, None, False
                if closed:
                    continue
                if held is not None:
                    for _ in range(held[2] - 1):  # all but the last of equal rows are followed by their like
                        yield held[0], held[1], held[1]
                    yield held[0], held[1], text
                held, closed = (doc, text, n), bool(extra)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            changed = [edited(t, following) for _, t, following in rows]
            # a document's next is as a rule the following row: each text is parsed once
            own = [t for _, t, _ in rows]
            ahead = [i for i, (_, _, f) in enumerate(rows) if i + 1 == len(rows) or own[i + 1] is not f]
            got = signatures(own + changed + [rows[i][2] for i in ahead])
            n = len(rows)
            following = got[1:n] + [None]
            for k, i in enumerate(ahead):
                following[i] = got[2 * n + k]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([as_text(s) for s in got[:n]]), pa.array([as_text(s) for s in got[n : 2 * n]]),
                    pa.array([1.0 if own[i] == changed[i] else likeness(got[i], got[n + i]) for i in range(n)]), pa.array([1.0 if own[i] == rows[i][2] else likeness(got[i], following[i]) for i in range(n)]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        rows, size = [], 0
        for row in pairs(batches):
            rows.append(row)
            size += len(row[1])
            if size >= CHUNK:
                yield flush(rows)
                rows, size = [], 0
        if rows:
            yield flush(rows)

    return with_next(docs).mapInArrow(made, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
