"""Near-duplicate groups by shingle similarity, as the pipeline takes them: SimHash links first, then everything a fingerprint misses, all decided on whole shingle sets.

Two texts are similar if their sets of five-word shingles (64-bit names) have a Jaccard similarity of ``SIMILARITY`` or more, at any length; groups are the components. Texts that share 0.8 of their shingles differ in some
9 bits of a 64-bit SimHash and up to 14, a radius for which covering masks number 32,767; the two bits that covering finds at little cost reach texts of similarity 0.97 or so. The rest comes from prefix
filtering: in any fixed order of shingles, two similar sets share one of their first ``n - ceil(SIMILARITY * n) + 1``. The order puts shingles that are common in a sample of the texts last (any order is exact), so that few texts meet at a shingle.

Four rounds, in which pairs that are in one component already are left out:

1. the SimHash links, and stars at a few of each text's prefix shingles: a member of a shingle's group is tied to the first of its size class and of the class below, in an order that the shingle shuffles;
2. stars at some more;
3. stars at all prefix shingles;
4. all pairs at those prefix shingles whose texts are still in different components, as far as sizes, places and sketches allow the similarity. This round is exact by itself; those before leave it little to do, also in families of thousands.

A pair is refused without its sets only by proof: *odd sketches* (a bit for each slot, flipped by each shingle that falls there) differ in no more bits than the sets do in shingles. All others are compared by their whole sets.

Texts with the same words are one class (a 64-bit name of the words) from the start. A component's document with the smallest id stays; null ids stay only where there is no other. Of rows equal in id and text one stays. Null and
empty texts are one class. An empty table gives no rows. Extra columns stay. A very long text costs memory in proportion to its words, in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import forget, prepare, stored, text_of
from marlstone.llm.simhash import components, fingerprint, links
from marlstone.llm.words import Words, mixed, rolled

SHINGLE, SIMILARITY = 5, 0.8
#: Prefix shingles of a text at which the first two rounds make stars, about.
EARLY = (4, 16)
#: Up to so many texts are picked by a broadcast of their hashes.
MAX_BROADCAST_ROWS = 500_000
#: Members of a group that is no large one, and slots of the smallest odd sketch.
FEW, SLOTS = 64, 2048
RUN_ROWS = 2_000_000
#: Texts sampled for the common shingles, how many of them must hold one, and how many shingles are told apart as common.
SAMPLE, COMMON, MOST_COMMON = 10_000, 5, 200_000

Common = tuple[np.ndarray, np.ndarray]


class Shingles:
    """The shingles of a batch of texts."""

    def __init__(self, size: int):
        self.size, self.names = size, Words(fold=True)

    def read(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """For each text the name of its words and the names of its shingles, repeats included. Fewer words than a shingle are one."""
        v, bounds = self.names.read(column)
        every = rolled(v, self.size)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = b - a
            own = every[a : b - self.size + 1] if n >= self.size else mixed(rolled(v[a:b], n) + np.uint64(n)) if n else every[:0]
            yield self.whole(v[a:b]), own

    @staticmethod
    def whole(v: np.ndarray) -> int:
        """The name of a sequence of words."""
        place = mixed(np.arange(1, len(v) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        total = np.add.reduce(mixed(v ^ place), dtype=np.uint64) + np.uint64(len(v))
        return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def unique(hashes: np.ndarray) -> np.ndarray:
    h = np.sort(hashes)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def prefix(hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first of a set's ordered hashes, one of which any set of that similarity shares."""
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of at least eight times as many slots as the set has members (a power of two, and ``SLOTS`` at least), in bytes: whether an odd number of members falls there."""
    slots = max(SLOTS, 8 << max(len(hashes) - 1, 0).bit_length())
    at = (hashes >> np.uint64(7)) & np.uint64(slots - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=slots).astype(np.uint8) & 1, bitorder="little")


def folded(odd: np.ndarray, size: int = 0) -> np.ndarray:
    """An odd sketch of as many bytes as asked for (of ``SLOTS`` bits if not said), from a larger one."""
    while len(odd) > (size or SLOTS // 8):
        odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
    return odd


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """In how many members two sets differ at least, from their odd sketches."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def most_difference(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """In how many members similar sets of these sizes differ at most."""
    return (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def common_shingles(docs: DataFrame, size: int) -> Common:
    """Sorted names of shingles common in a sample of the texts, and their ranks from 1, the most common last. Any order of shingles makes an exact join; this one makes its groups small."""
    place = F.pmod(F.xxhash64(text_of()), F.lit(max(1, docs.count() // SAMPLE)))
    few = docs.where(place == 0).select("text").distinct()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for b in batches:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unique(s) for _, s in shingles.read(b.column("text")))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = few.mapInArrow(made, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    t = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h = t.column("h").to_numpy().astype(np.int64).view(np.uint64)
    rank = np.arange(len(h), 0, -1, dtype=np.int64)
    order = np.argsort(h)
    return h[order], rank[order]


def in_order(hashes: np.ndarray, common: Common) -> np.ndarray:
    """Sorted hashes by rank, those of no rank first."""
    if not len(common[0]) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
    return hashes[np.argsort(np.where(common[0][at] == hashes, common[1][at], 0), kind="stable")]


def read_once(docs: DataFrame, size: int, similarity: float, common: Common) -> DataFrame:
    """(doc_id, text_hash, words, n, fp, odd, prefix): the name of each text's words, and its set's size, SimHash, odd sketch and ordered prefix. The only pass over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most MOST_COMMON shingles

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for b in batches:
            rows = []
            for words, s in shingles.read(b.column("text")):
                u = unique(s)
                rows.append((words, len(u), int(np.uint64(fingerprint(s)).astype(np.int64)), odd_sketch(u).tobytes(), prefix(in_order(u, shared.value), similarity).tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *made], names=["doc_id", "text_hash", "words", "n", "fp", "odd", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), "text")
    return rows.mapInArrow(made, "doc_id long, text_hash long, words long, n int, fp long, odd binary, prefix binary")


_ENTRY = {"key": "<u8", "words": "<i8", "root": "<i8", "n": "<i4", "pos": "<i4"}
_LAST = _ENTRY | {"odd": f"V{SLOTS // 8}"}
_OPEN = {"words": "<i8", "key": "<u8", "pos": "<i4"}
_PAIR = {"a": "<i8", "b": "<i8"}


def _packed(share: np.ndarray, shares: int, columns: list[np.ndarray], kinds: dict[str, str]) -> pa.RecordBatch:
    """A row for each share, with the shares' part of the columns as bytes."""
    order = np.argsort(share, kind="stable")
    cuts = np.searchsorted(share[order], np.arange(shares + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    sorted_ = [c[order].astype(k) for c, k in zip(columns, kinds.values(), strict=True)]
    blobs = [pa.array([c[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary()) for c in sorted_]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *blobs], names=["share", *kinds])


def _schema(kinds: dict[str, str]) -> str:
    return "share int, " + ", ".join(f"{k} binary" for k in kinds)


def _by_share(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> Iterator[list[np.ndarray]]:
    """The columns of each share, whole."""
    held: dict[int, list[list[bytes]]] = {}
    for b in batches:
        for share, *blobs in zip(*(b.column(c).to_pylist() for c in ("share", *kinds)), strict=True):
            held.setdefault(share, []).append(blobs)
    while held:
        _, rows = held.popitem()
        yield [np.frombuffer(b"".join(blobs), k) for blobs, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]


def star_pairs(key: np.ndarray, words: np.ndarray, root: np.ndarray, n: np.ndarray, _: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every member of a key's group with the first of its size class and of the class below."""
    level = (np.log(np.maximum(n, 1)) / -math.log(similarity) + 1e-9).astype(np.int32)
    turn = mixed(key ^ words.view(np.uint64))
    order = np.lexsort((words, turn, level, key))
    key, words, root, level = key[order], words[order], root[order], level[order]
    head = np.append(True, (key[1:] != key[:-1]) | (level[1:] != level[:-1]))
    first = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    below = np.full(len(first), -1, np.int64)
    near = np.flatnonzero((key[first][1:] == key[first][:-1]) & (level[first][1:] == level[first][:-1] + 1)) + 1
    below[near] = first[near - 1]
    for center in (first[group], below[group]):
        good = np.flatnonzero(center >= 0)
        good = good[root[good] != root[center[good]]]
        yield words[center[good]], words[good]


def all_pairs(key: np.ndarray, words: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray, odd: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different roots within each key whose sizes, places and sketches allow the similarity when the key is the first shingle they share. A member of a large group meets those of other roots than the largest one only once."""
    order = np.argsort(key, kind="stable")
    key, words, root, n, pos = key[order], words[order], root[order], n[order], pos[order]
    bits = odd[order].view(np.uint64).reshape(len(key), -1)

    def able(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = np.minimum(n[i] - pos[i], n[j] - pos[j])
        good = (root[i] != root[j]) & (most >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
        at = np.flatnonzero(good)
        good[at] = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1) <= most_difference(n[i[at]], n[j[at]], similarity)
        return good

    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(edge, append=len(key))
    small = np.repeat(size <= FEW, size)
    for hop in range(1, min(FEW, len(key))):
        i = np.flatnonzero(small[:-hop] & (key[:-hop] == key[hop:]))
        if not len(i):
            break
        for at in range(0, len(i), 1 << 17):
            x = i[at : at + (1 << 17)]
            x = x[able(x, x + hop)]
            yield words[x], words[x + hop]
    for start, count in zip(edge[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        member = np.arange(start, start + count)
        _, of, each = np.unique(root[member], return_inverse=True, return_counts=True)
        main = of == np.argmax(each)
        others, rest = member[~main], member[main]
        for k, x in enumerate(others.tolist()):
            y = np.concatenate([rest, others[k + 1 :]])
            y = y[able(np.full(len(y), x), y)]
            yield np.full(len(y), words[x]), words[y]


def _dealt(rows: DataFrame, few: int | None, kinds: dict[str, str], parts: int) -> DataFrame:
    """(share, …): the entries of ``rows`` (words, root, n, prefix or key and pos, odd) for each share of the keys."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return _packed(((columns[0] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64), parts, columns, kinds)

        for b in batches:
            for r in b.to_pylist():
                if "prefix" in r:
                    key = np.frombuffer(r["prefix"], np.uint64)
                    pos = np.arange(len(key), dtype=np.int32)
                    if few is not None and len(key) > few:
                        pos = np.flatnonzero(mixed(key) < np.uint64(min(few / len(key), 1.0) * 2**63) * np.uint64(2)).astype(np.int32)
                        key = key[pos]
                else:
                    key, pos = np.frombuffer(r["key"], np.uint64), np.frombuffer(r["pos"], np.int32)
                m = len(pos)
                held.append((key, np.full(m, r["words"], np.int64), np.full(m, r["root"], np.int64), np.full(m, r["n"], np.int32), pos))
                if "odd" in kinds:
                    held[-1] += (np.repeat(folded(np.frombuffer(r["odd"], np.uint8)).view(kinds["odd"]), m),)
                many += m * len(kinds)
            if many >= RUN_ROWS * len(_ENTRY):
                yield flush()
                held, many = [], 0
        if many:
            yield flush()

    return rows.mapInArrow(dealt, _schema(kinds)).repartitionById(parts, F.col("share"))


def _mixed(key: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The entries whose key has members of several roots, in the order of keys."""
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    several = np.maximum.reduceat(root[order], edge) != np.minimum.reduceat(root[order], edge)
    return order[np.repeat(several, np.diff(edge, append=len(key)))]


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def _distinct_pairs(runs: DataFrame, kinds: dict[str, str], pairing: Callable[..., Pairs], parts: int) -> DataFrame:
    """Distinct (a, b), from the pairs of each share's entries."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_share(batches, kinds):
            use = _mixed(columns[0], columns[2])
            held, many = [], 0
            for x, y in pairing(*(c[use] for c in columns)) if len(use) else ():
                held.append((np.minimum(x, y), np.maximum(x, y)))
                many += len(x)
                if many >= RUN_ROWS:
                    yield told(held)
                    held, many = [], 0
            if many:
                yield told(held)

    def told(held: list) -> pa.RecordBatch:
        a, b = _once(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return _packed(((a ^ b).view(np.uint64) % np.uint64(parts)).astype(np.int64), parts, [a, b], _PAIR)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _by_share(batches, _PAIR):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _once(a, b)], names=["a", "b"])

    return runs.mapInArrow(paired, _schema(_PAIR)).repartitionById(parts, F.col("share")).mapInArrow(opened, "a long, b long")


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def stars(own: DataFrame, tied: DataFrame | None, similarity: float, few: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of different roots by stars at the prefix shingles. ``own``: (words, n, prefix), ``tied``: (node, root), ``few``: at about so many shingles of each text only."""
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = _dealt(_rooted(own.select("words", "n", "prefix"), tied), few, _ENTRY, parts)
    return _distinct_pairs(runs, _ENTRY, lambda *columns: star_pairs(*columns, similarity), parts)


def remaining(own: DataFrame, tied: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of different roots that can be similar: the exact prefix join. ``own``: (words, n, odd, prefix). Sketches go only to shingles whose texts have several roots."""
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, words, root, _, pos in _by_share(batches, _ENTRY):
            use = _mixed(key, root)
            if len(use):
                yield _packed((mixed(words[use].view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts, [words[use], key[use], pos[use]], _OPEN)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, key, pos in _by_share(batches, _OPEN):
            order = np.argsort(words, kind="stable")
            words, key, pos = words[order], key[order], pos[order]
            cuts = np.append(np.flatnonzero(np.append(True, words[1:] != words[:-1])), len(words))
            for i in range(0, len(cuts) - 1, 4096):
                c = cuts[i : i + 4097].tolist()
                lists = [[x[a:b].tobytes() for a, b in zip(c[:-1], c[1:], strict=True)] for x in (key, pos)]
                yield pa.RecordBatch.from_arrays([pa.array(words[c[:-1]]), pa.array(lists[0], pa.binary()), pa.array(lists[1], pa.binary())], names=["words", "key", "pos"])

    runs = _dealt(_rooted(own.select("words", "n", "prefix"), tied), None, _ENTRY, parts)
    open_ = runs.mapInArrow(still_open, _schema(_OPEN)).repartitionById(parts, F.col("share")).mapInArrow(of_texts, "words long, key binary, pos binary")
    last = _dealt(_rooted(open_.join(own.select("words", "n", "odd"), "words"), tied), None, _LAST, parts)
    return _distinct_pairs(last, _LAST, lambda *columns: all_pairs(*columns, similarity), parts)


def _rooted(rows: DataFrame, tied: DataFrame | None) -> DataFrame:
    if tied is None:
        return rows.withColumn("root", F.col("words"))
    return rows.join(tied.withColumnRenamed("node", "words"), "words", "left").withColumn("root", F.coalesce("root", "words"))


def whole_sets(docs: DataFrame, rows: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(words, whole) for the names in ``needed``: all their distinct shingles, sorted. ``rows``: (text_hash, words)."""
    chosen = stored(rows.join(needed, "words", "left_semi").groupBy("words").agg(F.min("text_hash").alias("__h")).select("__h").distinct(), "similar-chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= MAX_BROADCAST_ROWS else chosen

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for b in batches:
            got = [(words, unique(s).tobytes()) for words, s in shingles.read(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["words", "whole"])

    picked = docs.withColumn("__h", F.xxhash64(text_of())).join(chosen, "__h", "left_semi").select("text")
    return picked.mapInArrow(made, "words long, whole binary").dropDuplicates(["words"])


def checked(pairs: DataFrame, own: DataFrame, docs: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are similar enough. ``own``: (words, n, odd), each words once; ``rows``: (text_hash, words) of ``docs``."""
    left, right = (own.select(F.col("words").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-6)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("oa", "ob", "na", "nb")), strict=True)
            good = [least_difference(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= most_difference(n, m, similarity) for x, y, n, m in rows]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist(), strict=True):
                n, m = len(x) // 8, len(y) // 8
                shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                good.append(shared >= similarity * (n + m - shared) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    seen = stored(both.select("a", "b", "oa", "ob", "na", "nb").mapInArrow(possible, "a long, b long"), "similar-possible")
    needed = seen.select(F.explode(F.array("a", "b")).alias("words")).distinct()
    whole = stored(whole_sets(docs, rows, needed, size), "similar-whole")
    left, right = (whole.select(F.col("words").alias(c), F.col("whole").alias(f"w{c}")) for c in "ab")
    out = stored(seen.join(right, "b").join(left, "a").select("a", "b", "wa", "wb").mapInArrow(compared, "a long, b long"), "similar-checked")
    forget(seen)
    forget(whole)
    return out


def groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, root) for each row of ``docs``: rows with the same root are one near-duplicate group."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = stored(read_once(docs, size, similarity, common_shingles(docs, size)), "similar-rows")
    own = stored(rows.select("words", "n", "fp", "odd", "prefix").dropDuplicates(["words"]), "similar-own")
    # SimHash: one class for each fingerprint stands for those that share it
    named = stored(own.groupBy("fp").agg(F.min("words").alias("w")), "similar-fp")
    near = links(named.select("fp")).join(named.select(F.col("fp").alias("a"), F.col("w").alias("wa")), "a").join(named.select(F.col("fp").alias("b"), F.col("w").alias("wb")), "b").select(F.col("wa").alias("a"), F.col("wb").alias("b"))
    same = own.join(named, "fp").where("words <> w").select(F.col("w").alias("a"), F.col("words").alias("b"))
    first = near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(stars(own, None, similarity, EARLY[0])).distinct()

    def grown(pairs: DataFrame, before: DataFrame | None) -> DataFrame:
        """The components after a round: the tree edges of those before and the round's similar pairs."""
        edges = checked(pairs, own, docs, rows, size, similarity)
        if before is not None and edges.isEmpty():
            return before
        return components(edges if before is None else edges.unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    tied = grown(first, None)
    for few in (EARLY[1], None):
        tied = grown(stars(own, tied, similarity, few), tied)
    tied = grown(remaining(own, tied, similarity), tied)
    forget(named)
    return _rooted(rows.select("doc_id", "text_hash", "words"), tied).select("doc_id", "text_hash", "root")


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group."""
    member = stored(groups(docs, size, similarity), "similar-groups")
    chosen = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m")).select(F.col("m.doc_id").alias("__d"), F.col("m.text_hash").alias("__h"))
    rows = docs.withColumn("__t", F.xxhash64(text_of()))
    kept = rows.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")), "left_semi")
    if not member.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__t"])
    return kept.drop("__t")
