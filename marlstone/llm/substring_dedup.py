"""Substring dedup by prefix-partitioned suffix trees.

Every window of ``WINDOW`` words holds an *anchor*, the leftmost of its least prefixes of ``GRAM`` words in an order that all tasks share, so that equal windows have equal anchors at equal
places. The trees are sparse: their leaves are the suffixes that begin at anchors, some ninth of all, each with the words of the windows it is anchor of on both sides.

*Groups.* A suffix belongs to the group of its first ``GRAM`` words. One pass counts prefixes (buckets of names) over all texts. Prefixes that occur more often than half a bin holds come last in the order, so that a
window takes one as anchor only where it has nothing rarer; such a window becomes a suffix of its own, from the window's start, and its prefix is lengthened to the whole window. Groups are dealt to one bin for each shuffle
partition, by their names.

*Trees.* A bin's task orders its suffixes top-down: suffixes that agree on their first words are a node, the next word parts a node into its children, and a node of one leaf is dropped. At depth ``d`` the leaves
of a node that also agree on the ``WINDOW - d`` words to the left share a window: every one but the least (document, start) begins a repeat. Nodes and left sides are compared word by word. Adjacent
repeats join to the maximal repeated passages (``passages``).

A task first looks for equal suffixes with equal surroundings among those it has at hand and sends on the least only: a passage that a third of all rows share costs a bin a few suffixes for each task, not for each row.
Words are told apart by 64-bit names, windows by the names of all their words: two different ones are taken for equal only if they differ in nothing but words whose names collide.

Words end at U+0020 and U+0009 to U+000D. Null texts have no words, nothing to remove and the digest of the empty string. Documents with the same id (null ids are one, after all others) are
ordered by the hash of their text and count as different documents; of equal rows all but one are removed. An empty table gives no rows. Extra columns stay, except those that are added. A text of any length is one
document: a task holds 8 bytes for each of its words, and its suffixes go to many bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import forget, prepare, stored
from marlstone.llm.words import Words, mixed, powers_of, rolled

WINDOW, GRAM = 20, 4
#: Words a task looks at together, and bytes of text that it reads at once; a longer text is taken whole.
CHUNK, PIECE = 600_000, 2 << 20
#: Documents sampled for the words that get short numbers on the way; the sample decides nothing but bytes.
SAMPLE, NUMBERED, SLOTS = 10_000, (1 << 16) - 1, 20
#: Buckets of names that are counted, at least and for each bin.
BUCKETS, BUCKETS_PER_BIN = 1 << 16, 16

_LAST = 2**63 - 1
_BASE = 0xD6E8FEB86659FD95


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


@dataclass
class Suffixes:
    """Suffixes with the words around them. ``words`` holds ``many + window - 1`` words for each: those of windows ``low`` to ``low + many - 1`` of its document; the suffix begins ``left`` words after the first."""

    doc: np.ndarray
    copy: np.ndarray
    low: np.ndarray
    many: np.ndarray
    left: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def taken(self, which: np.ndarray, window: int) -> Suffixes:
        size = self.many.astype(np.int64) + (window - 1)
        begin = np.cumsum(size) - size
        return Suffixes(self.doc[which], self.copy[which], self.low[which], self.many[which], self.left[which], self.words[_ranges(begin[which], size[which])])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, … for ``size[0]`` numbers, then the same for the next."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of some ``PIECE`` bytes of text each, or one of a longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = upto // PIECE
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(names of words, bounds of documents among them, document, copy) of documents of at least a window."""
    names = Words(fold=False)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def chunk():
        length = np.concatenate([x[1] for x in held])
        return np.concatenate([x[0] for x in held]), np.append(0, np.cumsum(length)), *(np.concatenate([x[i] for x in held]) for i in (2, 3))

    for b in (p for batch in batches for p in _pieces(batch)):
        v, bounds = names.read(b.column("text"))
        length = np.diff(bounds)
        keep = np.flatnonzero(length >= window)
        if not len(keep):
            continue
        if len(keep) < len(length):
            v = v[_ranges(bounds[keep], length[keep])]
        held.append((v, length[keep], b.column("doc_key").to_numpy()[keep], b.column("copy").to_numpy()[keep]))
        size += len(v)
        if size >= CHUNK:
            yield chunk()
            held, size = [], 0
    if size:
        yield chunk()


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return (name >> np.uint64(20)).astype(np.int64) & (buckets - 1)


def buckets_for(bins: int) -> int:
    return max(BUCKETS, 1 << (BUCKETS_PER_BIN * bins - 1).bit_length())


def heavy_buckets(docs: DataFrame, window: int, gram: int, bins: int) -> np.ndarray:
    """Buckets of prefixes that occur more often than half a bin holds suffixes; at most some twenty for each bin. All texts are counted."""
    buckets = buckets_for(bins)
    share = -(-buckets // bins)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for v, bounds, *_ in _chunks(batches, window):
            inside = np.ones(max(len(v) - gram + 1, 0), bool)
            for back in range(1, gram):
                inside[bounds[1:-1] - back] = False
            total += np.bincount(_bucket(rolled(v, gram)[inside], buckets), minlength=buckets)
        rows = [(s, total[s * share : (s + 1) * share]) for s in range(bins)]
        rows = [(s, _packed(t)) for s, t in rows if t.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["share", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, counts in zip(b.column("share").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + _unpacked(counts, "<i8")
        for s, t in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([int(t.sum())], pa.int64()), pa.array([_packed(t)], pa.binary())], names=["share", "total", "counts"])

    sums = stored(docs.mapInArrow(counted, "share int, counts binary").repartitionById(bins, F.col("share")).mapInArrow(summed, "share int, total long, counts binary"), "dedup-counts")
    total = sums.agg(F.sum("total")).first()[0] or 0
    limit = max(1, int(total * 2 / (window - gram + 2) / bins / 2))

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, counts in zip(b.column("share").to_pylist(), b.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(_unpacked(counts, "<i8") > limit) + s * share)], names=["bucket"])

    found = sums.select("share", "counts").mapInArrow(heavy, "bucket long").toArrow().column("bucket").to_numpy()
    forget(sums)
    return found


def anchored(v: np.ndarray, bounds: np.ndarray, doc: np.ndarray, copy: np.ndarray, heavy: np.ndarray, window: int, gram: int) -> tuple[Suffixes, np.ndarray]:
    """The suffixes of a chunk at anchors, and the names of their prefixes, by which they are dealt. ``heavy``: for each bucket, whether its prefixes are too frequent."""
    name = rolled(v, gram)
    often = heavy[_bucket(name, len(heavy))]
    least = (name >> np.uint64(1)) | (often.astype(np.uint64) << np.uint64(63))
    at, span, wide = np.arange(len(least), dtype=np.int32), 1, window - gram + 1
    while span < wide:  # the leftmost least of each run of ``wide`` prefixes, by doubling
        step = min(span, wide - span)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    many = np.diff(bounds) - (window - 1)
    start = _ranges(bounds[:-1], many)
    of = np.repeat(np.arange(len(many)), many)
    anchor = at[start]
    single = often[anchor]  # nothing rarer in the window: it is a suffix of its own
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]) | single[1:])
    first = np.flatnonzero(new)
    low, owner, one = start[first], of[first], single[first]
    run = np.diff(first, append=len(start))
    key = name[anchor[first]]
    key[one] = _first_words(v, low[one], window)
    left = np.where(one, 0, anchor[first] - low)
    size = run + (window - 1)
    out = Suffixes(doc[owner], copy[owner], (low - bounds[owner]).astype(np.int32), run.astype(np.int32), left.astype(np.int32), v[_ranges(low, size)])
    return out, key


def _order_least(x: np.ndarray, s: Suffixes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of those that share ``x`` with another: the order by x, document and start, and which in that order begin a run of equal x."""
    order = np.argsort(x)
    same = x[order][1:] == x[order][:-1]
    again = np.append(False, same) | np.append(same, False) if len(x) else np.zeros(0, bool)
    few = order[again]
    few = few[np.lexsort((start[few], s.copy[few], s.doc[few], x[few]))]
    return few, np.append(True, x[few][1:] != x[few][:-1]) if len(few) else np.zeros(0, bool)


def _exact(x: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: Callable[[], np.ndarray], s: Suffixes, start: np.ndarray) -> np.ndarray:
    """Which are not the least of those with the same ``x``, a hash; ``equal`` compares on words, ``columns`` gives what the hash stands for, used if two different ones should share a hash."""
    few, head = _order_least(x, s, start)
    late, least = few[~head], few[head][np.cumsum(head) - 1][~head]
    if not equal(late, least).all():
        _, x = np.unique(columns(), axis=0, return_inverse=True)
        few, head = _order_least(x.ravel(), s, start)
        late = few[~head]
    out = np.zeros(len(x), bool)
    out[late] = True
    return out


def met_before(s: Suffixes, window: int) -> np.ndarray:
    """Which suffixes have all their windows, with the same place of the anchor, in an earlier suffix."""
    size = s.many.astype(np.int64) + (window - 1)
    begin = np.cumsum(size) - size
    widest = int(size.max(initial=0))
    power = powers_of(_BASE, widest)
    x = np.add.reduceat(s.words * power[_ranges(np.zeros(len(s), np.int64), size)], begin) if len(s) else np.zeros(0, np.uint64)
    x = mixed(x + s.many.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.left.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = (s.many[a] == s.many[b]) & (s.left[a] == s.left[b])
        a, b = a[good], b[good]
        differ = s.words[_ranges(begin[a], size[a])] != s.words[_ranges(begin[b], size[a])]
        good[good] = np.add.reduceat(differ, np.cumsum(size[a]) - size[a]) == 0 if len(a) else good[good]
        return good

    def columns() -> np.ndarray:
        out = np.zeros((len(s), widest + 2), np.uint64)
        out[:, 0], out[:, 1] = s.many, s.left
        out[np.repeat(np.arange(len(s)), size), 2 + _ranges(np.zeros(len(s), np.int64), size)] = s.words
        return out

    return _exact(x, equal, columns, s, s.low)


def tree_repeats(s: Suffixes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, copy, start) of the windows that also start earlier, from the nodes of the tree of ``s``."""
    size = s.many.astype(np.int64) + (window - 1)
    at = np.cumsum(size) - size + s.left  # where each suffix begins
    forward = size - s.left
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left_power = powers_of(_BASE, window + 1)
    first = _first_words(s.words, at, gram)
    which = np.argsort(first)
    node = np.cumsum(np.append(False, first[which][1:] != first[which][:-1])) if len(s) else which
    side = None
    for depth in range(1, window + 1):
        # the leaves of a node at this depth agree on so many words
        which, node = _grown(s.words, at, forward, which, node, depth)
        if not len(which):
            break
        reach = window - depth
        if depth < gram:
            continue
        if side is None:  # the name of what stands to the left, as far as any window of this depth reaches
            side = np.zeros(len(s), np.uint64)
            for j in range(1, reach + 1):
                has = which[s.left[which] >= j]
                side[has] += s.words[at[has] - j] * left_power[j]
        else:
            has = which[s.left[which] > reach]
            side[has] -= s.words[at[has] - reach - 1] * left_power[reach + 1]
        fits = np.flatnonzero((s.left[which] >= reach) & (s.left[which] - s.many[which] < reach))
        if not len(fits):
            continue
        own, group = which[fits], node[fits]
        part = Suffixes(s.doc[own], s.copy[own], s.low[own], s.many[own], s.left[own], s.words)
        start = s.low[own] + (s.left[own] - reach)

        def equal(a: np.ndarray, b: np.ndarray, own=own, group=group, reach=reach) -> np.ndarray:
            good = group[a] == group[b]
            for j in range(1, reach + 1):
                good &= s.words[at[own[a]] - j] == s.words[at[own[b]] - j]
            return good

        def columns(own=own, group=group, reach=reach) -> np.ndarray:
            return np.stack([group.astype(np.uint64), *(s.words[at[own] - j] for j in range(1, reach + 1))], axis=1)

        late = _exact(mixed(side[own] + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), equal, columns, part, start)
        found.append((part.doc[late], part.copy[late], start[late]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _first_words(words: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    name = np.zeros(len(at), np.uint64)
    for j in range(gram):
        name = mixed(name * np.uint64(_BASE) + words[at + j])
    return name


def _grown(words: np.ndarray, at: np.ndarray, forward: np.ndarray, which: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes parted by the word at ``depth``, without those of one leaf. ``which``: suffixes, those of a node together; ``node``: a number for each node, in order."""
    long = forward[which] >= depth
    if not long.all():
        which, node = which[long], node[long]
    word = words[at[which] + depth - 1]
    if not len(which):
        return which, node
    parted = np.zeros(int(node[-1]) + 1, bool)
    parted[node[1:][(node[1:] == node[:-1]) & (word[1:] != word[:-1])]] = True
    if parted.any():
        own = np.flatnonzero(parted[node])
        order = own[np.lexsort((word[own], node[own]))]
        which[own], word[own] = which[order], word[order]
    edge = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
    head = np.append(True, edge)
    shared = ~(head & np.append(edge, True))  # more than one leaf
    return which[shared], (np.cumsum(head) - 1)[shared]


def _planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _whole(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).view(kind).ravel()


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(a))


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return _whole(zstandard.ZstdDecompressor().decompress(blob), kind)


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Names of up to ``NUMBERED`` words, the most frequent of a sample first."""
    place = F.pmod(F.xxhash64("doc_key", "copy"), F.lit(max(1, docs.count() // SAMPLE)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, *_ in _chunks(batches, 1):
            name, n = np.unique(v, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n)], names=["name", "n"])

    counts = docs.where(place == 0).mapInArrow(counted, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "name").limit(NUMBERED).toArrow().column("name").to_numpy().astype(np.int64).view(np.uint64)


class _Numbers:
    """Words as 16-bit numbers where they are among the frequent ones, else as names."""

    def __init__(self, frequent: np.ndarray):
        self.names = np.append(frequent, np.uint64(0))
        self.slot = np.full(1 << SLOTS, len(frequent), np.uint16)
        self.slot[(frequent >> np.uint64(64 - SLOTS))[::-1]] = np.arange(len(frequent), dtype=np.uint16)[::-1]

    def packed(self, s: Suffixes) -> bytes:
        """Suffixes as bytes."""
        number = self.slot[s.words >> np.uint64(64 - SLOTS)]
        number[self.names[number] != s.words] = len(self.names) - 1
        rare = s.words[number == len(self.names) - 1]
        body = zstandard.ZstdCompressor(level=1).compress(b"".join([*(_planes(getattr(s, c).astype(k)) for c, k in _COLUMNS.items()), _planes(number)]))
        return np.array([len(s), len(s.words), len(body)], "<i8").tobytes() + body + rare.tobytes()

    def unpacked(self, blob: bytes) -> Suffixes:
        n, _, size = np.frombuffer(blob, "<i8", 3).tolist()
        raw = zstandard.ZstdDecompressor().decompress(blob[24 : 24 + size])
        columns, at = [], 0
        for kind in _COLUMNS.values():
            columns.append(_whole(raw[at : at + n * np.dtype(kind).itemsize], kind))
            at += n * np.dtype(kind).itemsize
        number = _whole(raw[at:], "<u2")
        words = self.names[number]
        words[number == len(self.names) - 1] = np.frombuffer(blob, "<u8", offset=24 + size)
        return Suffixes(*columns, words)

    def gathered(self, blobs: list[bytes]) -> Suffixes:
        """All suffixes of many runs; the runs are taken off the list one by one, so that little is held twice."""
        n, size = (sum(np.frombuffer(b, "<i8", 3)[i] for b in blobs) for i in (0, 1))
        out = Suffixes(*(np.empty(n, k) for k in _COLUMNS.values()), np.empty(size, np.uint64))
        at = upto = 0
        while blobs:
            s = self.unpacked(blobs.pop())
            for c in _COLUMNS:
                getattr(out, c)[at : at + len(s)] = getattr(s, c)
            out.words[upto : upto + len(s.words)] = s.words
            at, upto = at + len(s), upto + len(s.words)
        return out


_COLUMNS = {"doc": "<i8", "copy": "<i8", "low": "<i4", "many": "<i4", "left": "<i4"}


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_key, copy, low, many): windows ``low`` to ``low + many - 1`` also start earlier. ``docs``: (doc_key, copy, text)."""
    spark = docs.sparkSession
    bins, gram = int(spark.conf.get("spark.sql.shuffle.partitions")), min(GRAM, window)
    shared = spark.sparkContext.broadcast((heavy_buckets(docs, window, gram, bins), frequent_words(docs)))  # some twenty numbers a bin, 2**16 names
    buckets = buckets_for(bins)
    found_names = ["doc_key", "copy", "low", "many"]

    def told(doc: np.ndarray, copy: np.ndarray, low: np.ndarray, many: np.ndarray) -> list[pa.Array]:
        return [pa.array(doc, pa.int64()), pa.array(copy, pa.int64()), pa.array(low, pa.int32()), pa.array(many, pa.int32())]

    run_names = ["bin", "run", "found"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.zeros(buckets, bool)
        heavy[shared.value[0]] = True
        numbers = _Numbers(shared.value[1])
        for turn, (v, bounds, doc, copy) in enumerate(_chunks(batches, window)):
            s, key = anchored(v, bounds, doc, copy, heavy, window, gram)
            late = met_before(s, window)
            to = (mixed(key) % np.uint64(bins)).astype(np.int64)
            left = np.flatnonzero(~late)
            left = left[np.argsort(to[left], kind="stable")]
            cuts = np.searchsorted(to[left], np.arange(bins + 1))
            s2 = s.taken(left, window)
            ends = np.append(0, np.cumsum(s2.many.astype(np.int64) + (window - 1)))
            part = lambda x, a, b: Suffixes(*(getattr(x, c)[a:b] for c in _COLUMNS), x.words[ends[a] : ends[b]])
            rows = [(b, numbers.packed(part(s2, cuts[b], cuts[b + 1])), False) for b in np.flatnonzero(np.diff(cuts)).tolist()]
            if late.any():
                rows.append((turn % bins, numbers.packed(Suffixes(*(getattr(s, c)[late] for c in _COLUMNS), s.words[:0])), True))
            kinds = [pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=run_names)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        numbers = _Numbers(shared.value[1])
        for b in batches:
            for bin_, run, found in zip(*(b.column(c).to_pylist() for c in run_names), strict=True):
                if found:
                    s = numbers.unpacked(run)
                    yield pa.RecordBatch.from_arrays(told(s.doc, s.copy, s.low, s.many), names=found_names)
                else:
                    held.setdefault(bin_, []).append(run)
        for runs in held.values():
            doc, copy, start = tree_repeats(numbers.gathered(runs), window, gram)
            order = np.lexsort((start, copy, doc))
            doc, copy, start = doc[order], copy[order], start[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] != start[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
            for i in range(0, len(first), 1 << 17):
                f = first[i : i + (1 << 17)]
                many = np.diff(f, append=first[i + len(f)] if i + len(f) < len(first) else len(doc))
                yield pa.RecordBatch.from_arrays(told(doc[f], copy[f], start[f], many), names=found_names)

    runs = docs.mapInArrow(dealt, "bin int, run binary, found boolean").repartitionById(bins, F.col("bin"))
    return runs.mapInArrow(searched, "doc_key long, copy long, low int, many int")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_key, the id or for null the last, and copy, 0 unless ids repeat; then copies of an id are numbered by the hash of their text, over range partitions, so that no id has to fit one task."""
    keyed = docs.withColumn("doc_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    if keyed.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return keyed.withColumn("copy", F.lit(0).cast("long"))
    marked = stored(keyed.withColumns({"__h": F.xxhash64(F.coalesce("text", F.lit(""))), "__t": F.monotonically_increasing_id()}), "dedup-marked")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = marked.repartitionByRange(parts, "doc_key", "__h", "__t").sortWithinPartitions("doc_key", "__h", "__t").withColumn("copy", F.monotonically_increasing_id())
    return stored(placed.drop("__h", "__t"), "dedup-numbered")


def passages(low: np.ndarray, many: np.ndarray, window: int) -> np.ndarray:
    """The maximal stretches of words, (begin, end) each, that windows ``low`` to ``low + many - 1`` cover."""
    order = np.argsort(low, kind="stable")
    begin, end = low[order].astype(np.int64), np.maximum.accumulate((low + many)[order].astype(np.int64) + (window - 1))
    head = np.append(True, begin[1:] > end[:-1]) if len(begin) else np.zeros(0, bool)
    return np.stack([begin[head], end[np.append(head[1:], True)] if len(begin) else end], axis=1)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed, kept (the words left, joined by one space) and passages (begin and end, in words, of each maximal repeated stretch)."""
    prepare(docs.sparkSession)
    added = {"n_words": "long", "n_removed": "long", "kept": "string", "passages": T.ArrayType(T.StructType().add("begin", "long").add("end", "long"))}
    docs = numbered(docs.drop(*added, "doc_key", "copy", "low", "many"))
    found = stored(repeats(docs.select("doc_key", "copy", "text"), window), "dedup-repeats")
    each = found.groupBy("doc_key", "copy").agg(F.collect_list("low").alias("low"), F.collect_list("many").alias("many"))  # as long as the document
    joined = docs.join(each, ["doc_key", "copy"], "left")
    out = joined.select(*(c for c in docs.columns if c not in ("doc_key", "copy")), "low", "many")
    schema = out.drop("low", "many").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    stretch = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, stretches = [], [], [], []
            for text, low, many in zip(b.column("text"), b.column("low"), b.column("many"), strict=True):
                w = words_of(text.as_py())
                n_words.append(len(w))
                own = passages(low.values.to_numpy(), many.values.to_numpy(), window).tolist() if low.is_valid else []
                n_removed.append(sum(e - s for s, e in own))
                stretches.append([{"begin": s, "end": e} for s, e in own])
                if own:
                    ends = [0, *(e for _, e in own)]
                    w = [x for a, (b, _) in zip(ends, [*own, (len(w), None)], strict=True) for x in w[a:b]]
                kept.append(b" ".join(w).decode())
            rest = b.select([c for c in b.schema.names if c not in ("low", "many")])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(stretches, stretch)], names=[*rest.schema.names, *added])

    return out.mapInArrow(rebuilt, schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 19), ' ')) AS k FROM d, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM w),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE rn > 1)),
x AS (SELECT d.doc_id, len(ws) AS n, p AS j, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(p)),
k AS (SELECT x.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY j) AS s FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.j = g.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
