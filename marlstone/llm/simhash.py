"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of 64-bit hashes of a text's word shingles. Two fingerprints within ``RADIUS`` bits must be linked. Each bit
position gets a vector of ``RADIUS + 1`` bits, and each of the ``2 ** (RADIUS + 1) - 1`` non-zero vectors makes a mask of the
positions whose vector has an odd product with it. Any ``RADIUS`` positions leave some mask untouched, so every pair within the radius agrees
under some mask: the tables miss nothing.

Only distinct fingerprints go to the tables (a group of copies is one row, made by a partial aggregate), which are dealt by (mask, masked value) and
sorted; a task reads each bucket as a run and links within it. Small buckets compare their members directly. In larger ones every member is grouped
under each choice of ``RADIUS`` free bits left out, ``n * C(free, RADIUS)`` group memberships instead of all pairs, and buckets larger still are first split by
blocks of the free bits (some block agrees for every pair). A task emits a spanning forest, at most one link for each fingerprint and bucket. Components come from
alternating large-star and small-star rounds over those links, each stored in the shared folder; up to ``AT_ONCE`` links are joined in one task, with the same result:
the plans and jobs of the rounds cost the driver memory.

Null and empty texts have no shingles and fingerprint zero, and are linked like any other. A null doc_id has a fingerprint but names no component unless
the component has no other id. Equal rows repeat in the result. An empty table gives no rows. Columns other than doc_id and text are ignored. A very long text is read whole, in some 100 bytes of a task's memory for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import forget, prepare, stored

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Shingles of a text hashed together.
BLOCK = 1 << 16
#: Runs up to this size compare all members; from SPLIT members on, a bucket is dealt by blocks of its free bits.
DIRECT, SPLIT = 32, 4096
#: So many links, 16 MB of them, are joined in one task.
AT_ONCE = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words end at U+0020 and U+0009 to U+000D only. On UTF-8 bytes both are what ``bytes`` does."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([h(b" ".join(words), SEED)] if words else [], np.uint64)
    out = np.empty(len(words) - size + 1, np.uint64)
    for at in range(0, len(out), BLOCK):
        part = words[at : at + BLOCK + size - 1]
        out[at : at + BLOCK] = np.fromiter((h(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(size)))), np.uint64, len(part) - size + 1)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(words_of(t), size)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Position ``i`` has the vector ``i % (2 ** (radius + 1) - 1) + 1``: none is zero, so that each mask keeps about half of the bits or more."""
    n = (1 << (radius + 1)) - 1
    vector = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component of an undirected graph on 0 … n-1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def bucket_links(fp: np.ndarray, free: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints of one bucket (they differ in ``free`` bit positions only): the root of each under links within the radius.
    Any two within the radius agree once the right ``radius`` free bits are left out, and any that then agree are within it."""
    n = len(fp)
    root = np.arange(n)
    if n > DIRECT:
        for gone in combinations(free, min(radius, len(free))):
            rest = fp & ~np.uint64(sum(1 << int(i) for i in gone))
            order = np.argsort(rest, kind="stable")
            same = np.flatnonzero(rest[order][1:] == rest[order][:-1])
            if len(same):
                joined = _roots(n, np.concatenate([order[same], np.arange(n)]), np.concatenate([order[same + 1], root]))
                root = joined
        return root
    i, j = np.triu_indices(n, 1)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return _roots(n, i[near], j[near])


def links(distinct_fp: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a below b: a spanning forest of the links within each bucket, of distinct fingerprints ``fp``."""
    masks = covering_masks(radius)
    free = [np.array([i for i in range(BITS) if not m >> i & 1]) for m in masks]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = distinct_fp.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "key"))
    # Buckets too large for one task: again by radius + 1 blocks of the free bits, some of which agrees for every pair.
    sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT)
    large = stored(sizes, "simhash-large")
    rows = rows.withColumn("block", F.lit(-1)).withColumn("part", F.lit(0).cast("long"))
    if not large.isEmpty():
        block_masks = [[_signed(sum(1 << int(i) for i in part)) for part in np.array_split(f, radius + 1)] for f in free]
        marked = rows.drop("block", "part").join(large, ["mask", "key"], "left")
        parts = F.element_at(F.array(*(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in bm)) for bm in block_masks)), F.col("mask") + 1)
        split = marked.where(F.col("n").isNotNull()).select("fp", "mask", "key", F.posexplode(parts).alias("block", "part"))
        rows = marked.where(F.col("n").isNull()).select("fp", "mask", "key", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("part")).unionByName(split)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(mask, key, block, part, fp):
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(fp)]])
            size = np.repeat(ends - starts, ends - starts)
            run = np.repeat(np.arange(len(starts)), ends - starts)
            order = np.arange(len(fp))
            a, b = [], []
            small = size <= DIRECT
            for step in range(1, DIRECT):  # neighbours in all small runs at once
                i = np.flatnonzero(small[:-step] & (run[:-step] == run[step:])) if step < len(fp) else order[:0]
                if not len(i):
                    break
                near = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
                a.append(near)
                b.append(near + step)
            for r in np.flatnonzero(ends - starts > DIRECT):
                s, e = starts[r], ends[r]
                a.append(order[s:e])
                b.append(bucket_links(fp[s:e], free[mask[s]], radius) + s)
            root = _roots(len(fp), np.concatenate(a), np.concatenate(b)) if a else order
            tail = np.flatnonzero(root != order)
            x, y = fp[root[tail]].view(np.int64), fp[tail].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 200_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            c = [t.column(n).to_numpy() for n in ("mask", "key", "block", "part")]
            last = np.logical_and.reduce([x == x[-1] for x in c])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield flush(*(x[:cut] for x in c), t.column("fp").to_numpy()[:cut].view(np.uint64))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                yield flush(*(t.column(n).to_numpy() for n in ("mask", "key", "block", "part")), t.column("fp").to_numpy().view(np.uint64))

    columns = ["mask", "key", "block", "part"]
    dealt = rows.select(*columns, "fp").repartition(*columns).sortWithinPartitions(*columns, "fp")
    return dealt.mapInArrow(linked, "a long, b long").distinct()


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b); the root is the component's least node. Large-star and small-star rounds over stored tables:
    each round's tables are linear in the edges, a node's neighbours are only ever aggregated, never gathered, and rounds grow with the logarithm of the size. A round that leaves the edges as they are
    (their number and the sums of two hashes) is the last. Up to ``AT_ONCE`` edges need no rounds."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("v", pa.int64()), ("u", pa.int64())]))
        node, at = np.unique(np.concatenate([t.column("v").to_numpy(), t.column("u").to_numpy()]), return_inverse=True)
        root = _roots(len(node), at[: len(t)], at[len(t) :])
        tail = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[tail]), pa.array(node[root[tail]])], names=["node", "root"])

    def digest(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    now = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), label)
    if now.count() <= AT_ONCE:
        out = stored(now.repartition(1).mapInArrow(joined, "node long, root long"), label)
        forget(now)
        return out
    seen = digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u is tied to the least node around u
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(down, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(small, label)
        forget(now)
        now, before, seen = after, seen, digest(after)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``."""
    marks = stored(fingerprints(docs, size), "simhash-fp")
    groups = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    tied = components(links(groups.select("fp"), radius))
    named = groups.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
