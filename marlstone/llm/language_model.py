"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Level 1 holds the sorted 64-bit hashes of all training tokens; a token's id is its rank. A higher level holds the kept n-grams under their context, the entry of the level
below: monotone pointers give each context's range, and within it the word ids, made monotone by the context's number, are found by successor search. Beside an entry stands its discounted probability in 8
bits (steps of its logarithm, from 1 down to the shard's least), beside a context the mass left to shorter contexts in 8 bits (interpolated absolute discounting, so that probabilities sum to one whatever is pruned). N-grams of two and more words
are kept from ``MIN_COUNT`` occurrences; all are counted.

Counting goes level by level: a task packs sorted (key, count) runs for each share of the keys, shares are merged, and kept n-grams are range-partitioned by (context, word)
into trie shards of some ``SHARD_ENTRIES``, which tasks write to the shared folder. A context with more successors than that goes on in the next shard; what each shard has of its first and last context is added up.
Workers map these files into memory, so that what a worker holds is what it touches. Where the shared folder is no local path, an executor fetches a file when one of its workers first needs it
into the folder that Spark keeps for the executor's files. Nothing of the model passes through the driver but a line for each shard.

Tokens are words (A-Z lower-cased, ended by U+0020 and U+0009 to U+000D) and one end for each text. Null and empty texts are one end. Words are known by their 64-bit
hash. Repeated rows count and score each time. With no training text every score is that of unknown tokens; an empty table gives no rows. A very long text is read whole, 8 bytes a token in each of a dozen arrays.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import forget, held_out, new_path, prepare, stored
from marlstone.llm.elias_fano import EliasFano
from marlstone.llm.words import Words

ORDER, MIN_COUNT, DISCOUNT = 3, 2, 0.75
#: The hash of a text's end.
END = np.uint64(0xE4D0E4D0E4D0E4D1)
#: Keys a task counts before it packs a run.
RUN_TOKENS = 3_000_000
#: Entries of a trie shard, about.
SHARD_ENTRIES = 2_000_000
#: Words a worker remembers: two to this power.
MEMORY = 20

_SIGN = np.uint64(1 << 63)


def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if ":" in root.split("/", 1)[0] else (fs.LocalFileSystem(), root)


def _write(root: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    system, base = _system(root)
    system.create_dir(base, recursive=True)
    for part, array in arrays.items():
        temporary = f"{base}/.{name}.{part}.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
        system.move(temporary, f"{base}/{name}.{part}.npy")  # whole or not at all, whichever attempt ends first


def _loaded(root: str, name: str) -> np.ndarray:
    """A file of the model as a memory map; from a remote store it is fetched once for each executor."""
    from pyarrow import fs

    system, base = _system(root)
    if isinstance(system, fs.LocalFileSystem):
        return np.asarray(np.load(f"{base}/{name}.npy", mmap_mode="r"))
    folder = os.path.join(SparkFiles.getRootDirectory(), base.strip("/").replace("/", "_"))
    if not os.path.exists(path := f"{folder}/{name}.npy"):
        os.makedirs(folder, exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        fs.copy_files(f"{base}/{name}.npy", part, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        os.replace(part, path)
    return np.asarray(np.load(path, mmap_mode="r"))


@dataclass(frozen=True)
class Shard:
    """A line for the driver: contexts ``first`` … ``first + contexts - 1`` (hashes for level 1), from word ``word`` of the first one, whose entries are numbered from ``offset``. ``ends``: the mass that
    the first and the last context leave, all shards together."""

    name: str
    first: int
    word: int
    contexts: int
    offset: int
    n: int
    meta: str
    ends: tuple[float, float] = (1.0, 1.0)


@dataclass(frozen=True)
class Model:
    root: str
    tokens: int
    words: int
    levels: tuple[tuple[Shard, ...], ...]

    def opened(self) -> Trie:
        key = (self.root, len(self.levels))
        if _open.get("key") != key:
            _open.clear()
            _open.update(key=key, trie=Trie(self))
        return _open["trie"]


_open: dict = {}


class _Memory:
    """The last answers by key, in slots by the key's hash: ``told`` overwrites, ``asked`` says which keys are there."""

    def __init__(self, answers: tuple[type, ...]):
        self.key = np.zeros(1 << MEMORY, np.int64)
        self.key[0] = 1  # no slot holds a key of its own at first: 0 belongs to slot 0, and 1 to another
        self.answers = [np.zeros(1 << MEMORY, k) for k in answers]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMORY)

    def asked(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        slot = self._slots(keys)
        return np.flatnonzero(self.key[slot] != keys), [a[slot] for a in self.answers]

    def told(self, keys: np.ndarray, answers: list[np.ndarray]) -> None:
        slot = self._slots(keys)
        _, last = np.unique(slot[::-1], return_index=True)  # of two keys for a slot one stays
        own = len(slot) - 1 - last
        self.key[slot[own]] = keys[own]
        for a, b in zip(self.answers, answers, strict=True):
            a[slot[own]] = b[own]

    def through(self, keys: np.ndarray, search) -> list[np.ndarray]:
        """The answers for all keys; ``search`` gives them for sorted distinct ones that are not remembered."""
        missing, out = self.asked(keys)
        if len(missing):
            each, back = np.unique(keys[missing], return_inverse=True)
            found = search(each)
            for a, b in zip(out, found, strict=True):
                a[missing] = b[back]
            self.told(each, found)
        return out


class Trie:
    """A model's levels as memory maps."""

    def __init__(self, model: Model):
        self.model = model
        self.wide = model.words + 1
        self.levels = []
        for k, shards in enumerate(model.levels):
            own = [self._opened(s, k) for s in shards]
            # hashes, or (context, word) as one number
            starts = np.array([s.first for s in shards], np.uint64) if not k else np.array([s.first * self.wide + s.word + 1 for s in shards], np.int64)
            self.levels.append((starts, own))
        self.memory = _Memory((np.int64, np.int64))

    def _opened(self, shard: Shard, level: int) -> dict:
        load, meta = (lambda part: _loaded(self.model.root, f"{shard.name}.{part}")), json.loads(shard.meta)

        def sequence(kind: str) -> EliasFano:
            return EliasFano(**meta[kind], parts={p: load(f"{kind}-{p}") for p in ("low", "high", "ones")})

        out = {"shard": shard, "ids": sequence("ids"), "counts": load("counts")}
        return out | {"pointers": sequence("pointers"), "alpha": load("alpha"), "rest": load("rest"), "alphas": 10.0 ** (np.arange(256) * (meta["floor"] / 255))} if level else out

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts; -1 and 0 for words not met in training."""
        return tuple(self.memory.through(hashes.view(np.int64), self._words))

    def _words(self, keys: np.ndarray) -> list[np.ndarray]:
        hashes = keys.view(np.uint64)
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        firsts, own = self.levels[0]
        if not own:
            return [ids, counts]
        at = np.searchsorted(firsts, hashes, side="right") - 1
        for s in np.unique(at[at >= 0]):
            q = np.flatnonzero(at == s)
            found = own[s]["ids"].find(hashes[q] - firsts[s])
            hit = found >= 0
            ids[q[hit]] = found[hit] + own[s]["shard"].offset
            counts[q[hit]] = own[s]["counts"][found[hit]]
        return [ids, counts]

    def extend(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of ``level`` (from 1) for contexts and next words, their discounted probability (0 if absent), and the mass each context leaves."""
        n = len(context)
        if not n or not self.levels[level][1]:
            return np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        pairs, back = np.unique(context * self.wide + (word + 1), return_inverse=True)
        return tuple(x[back] for x in self._extend(level, pairs))

    def _extend(self, level: int, pairs: np.ndarray) -> list[np.ndarray]:
        """For sorted distinct pairs."""
        starts, own = self.levels[level]
        c = pairs // self.wide
        w = pairs - c * self.wide - 1
        index, alpha, rest = np.full(len(c), -1, np.int64), np.zeros(len(c)), np.ones(len(c))
        new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        near, which = c[new], np.repeat(np.arange(len(new)), np.diff(new, append=len(c)))
        # the last shard that can hold a context, where what it leaves is told
        last = np.searchsorted(starts, near * self.wide + (self.wide - 1), side="right") - 1
        leaves = np.ones(len(near))
        for s in np.unique(last[last >= 0]).tolist():
            shard = own[s]["shard"]
            q = np.flatnonzero((last == s) & (near - shard.first < shard.contexts))
            local = near[q] - shard.first
            leaves[q] = own[s]["rest"][local] / 255.0
            for end, value in zip((0, shard.contexts - 1), shard.ends, strict=True):
                leaves[q[local == end]] = value
        rest = leaves[which]
        at = np.searchsorted(starts, pairs, side="right") - 1
        edges = np.searchsorted(at, np.arange(len(own) + 1))  # pairs and shards are both in order
        for s in np.flatnonzero(np.diff(edges)).tolist():
            part, shard = own[s], own[s]["shard"]
            a, b = int(edges[s]), int(edges[s + 1])
            local = near[which[a] : which[b - 1] + 1] - shard.first
            good = np.flatnonzero(local < shard.contexts)
            if not len(good):
                continue
            begin, end = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
            begin[good], end[good] = part["pointers"].access_pairs(local[good])
            mine = which[a:b] - which[a]
            q = np.flatnonzero((end > begin)[mine] & (w[a:b] >= 0))
            mine = mine[q]
            found = part["ids"].find(local[mine].astype(np.uint64) * np.uint64(self.model.words) + w[a + q].astype(np.uint64), begin[mine], end[mine])
            hit = found >= 0
            index[a + q[hit]] = found[hit] + shard.offset
            alpha[a + q[hit]] = part["alphas"][part["alpha"][found[hit]]]
        return [index, alpha, rest]

    def counts(self, level: int, index: np.ndarray) -> np.ndarray:
        _, own = self.levels[level]
        out = np.zeros(len(index), np.int64)
        for x in own:
            q = np.flatnonzero((index >= x["shard"].offset) & (index < x["shard"].offset + x["shard"].n))
            out[q] = x["counts"][index[q] - x["shard"].offset]
        return out


class Tokens:
    """The tokens of a batch: words by the hashes of their folded letters, and an end for each text."""

    def __init__(self):
        self.names = Words(fold=True)

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the tokens of all texts in a row, and where each text starts."""
        v, bounds = self.names.read(column)
        return np.insert(v, bounds[1:], END), bounds[:-1] + np.arange(len(column))


def _before(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value one token earlier in the same text, else -1."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = -1
    return out


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in (np.diff(keys, prepend=np.uint64(0)), counts))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 8, -1)
    deltas, counts = (np.ascontiguousarray(a.T).view("<u8").ravel() for a in raw)
    return np.cumsum(deltas, dtype=np.uint64), counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _ranges(shards: int) -> np.ndarray:
    """First hash of each of equal ranges of the 64-bit hashes."""
    return np.array([(i << 64) // shards for i in range(shards)], np.uint64)


def _runs(docs: DataFrame, model: Model | None, level: int, shards: int) -> DataFrame:
    """(shard, run) of the keys of one level in training texts: hashes dealt by range, or context * words + word dealt by a hash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ranges = _ranges(shards)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value.opened() if shared.value else None
        tokens = Tokens()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            if trie is None:
                to = np.searchsorted(ranges, keys, side="right") - 1
            else:
                to = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards
            order = np.argsort(to.astype(np.uint16) if shards < 1 << 16 else to, kind="stable")  # of 16 bits: by radix
            cuts = np.searchsorted(to[order], np.arange(shards + 1))
            full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            runs = [_packed(keys[o], counts[o]) for o in (order[cuts[s] : cuts[s + 1]] for s in full)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(runs, pa.binary())], names=["shard", "run"])

        for b in batches:
            hashes, starts = tokens.read(b.column("text"))
            if trie is None:
                met, c = np.unique(hashes, return_counts=True)
                held.append((met, c.astype(np.uint64)))
            else:
                word, _ = trie.words(hashes)
                index = word
                for k in range(1, level):
                    context = _before(index, starts)
                    index = np.full(len(word), -1, np.int64)
                    q = np.flatnonzero(context >= 0)
                    index[q] = trie.extend(k, context[q], word[q])[0]
                context = _before(index, starts)
                q = context >= 0
                held.append(np.unique(context[q].astype(np.uint64) * np.uint64(shared.value.words) + word[q].astype(np.uint64), return_counts=True))
                held[-1] = (held[-1][0], held[-1][1].astype(np.uint64))
            size += len(held[-1][0])
            if size >= RUN_TOKENS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(counted, "shard int, run binary")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The runs of each shard, which come together, as one."""
    now, runs = None, []

    def done() -> tuple[int, np.ndarray, np.ndarray]:
        parts = [_unpacked(r) for r in runs]
        return now, *_summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

    for b in batches:
        for shard, run in zip(b.column("shard").to_pylist(), b.column("run").to_pylist(), strict=True):
            if shard != now and runs:
                yield done()
                runs = []
            now = shard
            runs.append(run)
    if runs:
        yield done()


_LINES = "name string, first decimal(20,0), word long, last decimal(20,0), contexts long, n long, total long, first_mass double, last_mass double, meta string"


def _line(name: str, first: int, word: int, contexts: int, n: int, total: int, masses: tuple[float, float], meta: dict) -> pa.RecordBatch:
    from decimal import Decimal

    values = [(name, pa.string()), (Decimal(first), pa.decimal128(20, 0)), (word, pa.int64()), (Decimal(first + max(contexts, 1) - 1), pa.decimal128(20, 0)), (contexts, pa.int64()), (n, pa.int64()), (total, pa.int64()), (masses[0], pa.float64()), (masses[1], pa.float64()), (json.dumps(meta), pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=[x.split()[0] for x in _LINES.split(", ")])


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or int(counts.max()) < 2**32 else np.uint64)


def _numbered(lines: list) -> tuple[Shard, ...]:
    """The shards in order. A context that several shards share leaves what all of them together leave."""
    mass: dict[int, float] = {}
    for r in lines:
        mass[int(r.first)] = mass.get(int(r.first), 0.0) + r.first_mass
        if r.last != r.first:
            mass[int(r.last)] = mass.get(int(r.last), 0.0) + r.last_mass
    out, at = [], 0
    for r in sorted(lines, key=lambda r: (int(r.first), r.word)):
        ends = tuple(max(round((1 - mass[int(x)]) * 255), 1) / 255 for x in (r.first, r.last))
        out.append(Shard(r.name, int(r.first), r.word, r.contexts, at, r.n, r.meta, ends))
        at += r.n
    return tuple(out)


def _whole(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """A partition's columns, a shard's worth."""
    held = [b for b in batches if b.num_rows]
    return [c.to_numpy() for c in pa.Table.from_batches(held).columns] if held else None


def _ranged(table: DataFrame, *by: str) -> DataFrame:
    return table.repartitionByRange(max(1, math.ceil(table.count() / SHARD_ENTRIES)), *by).sortWithinPartitions(*by)


def _unigrams(docs: DataFrame, root: str, shards: int) -> Model:
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, counts in _merged(batches):
            for i in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array((keys[i : i + (1 << 17)] ^ _SIGN).view(np.int64)), pa.array(counts[i : i + (1 << 17)].astype(np.int64))], names=["word", "n"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if columns := _whole(batches):
            keys, counts = columns[0].view(np.uint64) ^ _SIGN, columns[1]
            name = f"1-{TaskContext.get().partitionId()}"
            meta, parts = EliasFano.encode(keys - keys[0])
            _write(root, name, {f"ids-{p}": a for p, a in parts.items()} | {"counts": _narrow(counts)})
            yield _line(name, int(keys[0]), 0, 0, len(keys), int(counts.sum()), (0.0, 0.0), {"ids": meta})

    table = stored(_runs(docs, None, 1, shards).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(kept, "word long, n long"), "lm-kept")
    lines = _ranged(table, "word").mapInArrow(built, _LINES).collect()  # a line for each shard
    forget(table)
    return Model(root, sum(r.total for r in lines), sum(r.n for r in lines), (_numbered(lines),))


def _next_level(docs: DataFrame, model: Model, shards: int, min_count: int) -> Model:
    level = len(model.levels)
    contexts = sum(s.n for s in model.levels[-1])
    if (contexts + 1) * (model.words + 1) >= 2**63:
        raise OverflowError("contexts times words exceed 63 bits: raise min_count")
    words = np.uint64(max(model.words, 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, counts in _merged(batches):
            keep = counts >= min_count
            keys, counts = keys[keep], counts[keep]
            for i in range(0, len(keys), 1 << 17):
                k, c = keys[i : i + (1 << 17)], counts[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array((k // words).astype(np.int64)), pa.array((k % words).astype(np.int64)), pa.array(c.astype(np.int64))], names=["context", "word", "n"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _whole(batches)
        if not columns:
            return
        c, w, n = columns
        first = int(c[0])
        local = c - first
        sizes = np.bincount(local)
        below = shared.value.opened().counts(level - 1, c[np.append(True, c[1:] != c[:-1])])
        total = np.ones(len(sizes), np.int64)
        total[np.flatnonzero(sizes)] = below
        alpha = (n - DISCOUNT) / total[local]
        mass = np.bincount(local, weights=alpha, minlength=len(sizes))
        floor = min(float(np.log10(alpha.min())), -1e-6)
        ids, id_parts = EliasFano.encode(local.astype(np.uint64) * words + w.astype(np.uint64))
        pointers, pointer_parts = EliasFano.encode(np.concatenate([[0], np.cumsum(sizes)]))
        arrays = {f"ids-{p}": a for p, a in id_parts.items()} | {f"pointers-{p}": a for p, a in pointer_parts.items()}
        arrays |= {"alpha": np.clip(np.rint(np.log10(alpha) * (255 / floor)), 0, 255).astype(np.uint8), "rest": np.clip(np.rint((1 - mass) * 255), 1, 255).astype(np.uint8), "counts": _narrow(n)}
        name = f"{level + 1}-{TaskContext.get().partitionId()}"
        _write(model.root, name, arrays)
        yield _line(name, first, int(w[0]), len(sizes), len(n), int(n.sum()), (float(mass[0]), float(mass[-1])), {"ids": ids, "pointers": pointers, "floor": floor})

    counted = _runs(docs, model, level, shards).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    table = stored(counted.mapInArrow(kept, "context long, word long, n long"), "lm-kept")
    lines = _ranged(table, "context", "word").mapInArrow(built, _LINES).collect()  # a line for each shard
    forget(table)
    return Model(model.root, model.tokens, model.words, (*model.levels, _numbered(lines)))


def fit(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    """Learn from all rows of ``docs``. Shares of the counting follow ``spark.sql.shuffle.partitions``, which is sized to the data."""
    spark = docs.sparkSession
    prepare(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = _unigrams(docs, new_path(spark, "lm"), shards)
    for _ in range(1, order):
        model = _next_level(docs, model, shards, min_count)
    return model


def score_texts(model: Model, trie: Trie, tokens: Tokens, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and model score of each text."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    hashes, starts = tokens.read(texts)
    word, count = trie.words(hashes)
    p = (count + 0.5) / (model.tokens + 0.5 * (model.words + 1))
    base = np.log10(p)
    index = word
    for level in range(1, len(model.levels)):
        context = _before(index, starts)
        index = np.full(len(word), -1, np.int64)
        q = np.flatnonzero(context >= 0)
        index[q], alpha, rest = trie.extend(level, context[q], word[q])
        p[q] = alpha + rest * p[q]
    lengths = np.diff(np.append(starts, len(hashes)))
    return lengths, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with text) and n_tokens, n_known, base_score, score; the text is dropped."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    rest = [c for c in docs.columns if c != "text" and c not in added]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = shared.value, Tokens()
        trie = model.opened()
        for b in batches:
            got = score_texts(model, trie, tokens, b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *map(pa.array, got)], names=[*rest, *added])

    schema = docs.select(*rest).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return docs.select(*rest, "text").mapInArrow(scored, schema)


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(~held_out(5)))
    out = score(docs.withColumn("held_out", held_out(5)), model)
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
