"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A text's lattice has an arc for each vocabulary piece that stands at a place, and for a character that no piece covers an arc of its bytes below every piece's score. Forward Viterbi gives
each node the score of its best path from the start. Searching backwards from the end, that score is exactly what a partial path can still reach, so that A-star with it as
heuristic pops complete segmentations best first and never expands a node in vain.

No piece holds a blank but at its front, nor a line feed, so that the lattice falls apart at both: units are segmented on their own, once for each distinct unit of a task. A unit also learns the loss of its
second-best path (forward and backward scores over the arcs off the best path). The N best of a text can leave the best path only in the N - 1 units with the least such losses; A-star runs on those and
the sums of their paths are merged.

Text is kept as it is: a blank is put in front, as the vocabulary expects, and decoding takes it off again. Every text decodes to itself, U+2581 and characters outside the
vocabulary by their bytes. Null and empty texts have no pieces and score 0. Pieces that are marked never to be used (score -1e9, runs of blanks) make no arcs. The vocabulary (some 32,000 pieces, read by
the driver from ``model_path``) is broadcast. Extra columns stay, except those that are added. Repeated rows are encoded each; an empty table gives no rows. A very long text is taken unit by unit; a unit is as long as its longest word, whose lattice takes
some 500 bytes of a task's memory for each character.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import newest, prepare

N_BEST = 4
#: Scores at or below this mark pieces never to be used; characters without a piece score this much below the least piece.
NEVER, UNKNOWN_GAP = -1e8, 10.0
#: Distinct units a task remembers, and characters up to which units are segmented together.
MEMO_UNITS, TOGETHER = 500_000, 64

_UNITS = re.compile(r" ?[^ \n]+|\n| ")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Of each row of code points."""
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = _further(h, column)
    return h


def _further(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ (code.astype(np.uint64) + np.uint64(1))) * _BASE
    return h ^ (h >> np.uint64(32))


class Vocabulary:
    """Pieces with blanks as blanks, their scores, and the ids of the 256 bytes."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.surface: list[bytes] = []
        bytes_: dict[int, int] = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.surface.append(text.encode())
                if sp.get_score(i) > NEVER:
                    self.pieces[text] = (i, sp.get_score(i))
        if len(bytes_) < 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        self.bytes = [bytes_[b] for b in range(256)]
        if any(" " in p[1:] or "\n" in p for p in self.pieces):
            raise ValueError("pieces hold inner blanks or line feeds")
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_GAP
        self.prefixes = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        # for each length, the hashes of pieces and their beginnings, sorted, with piece ids (-1: only a beginning) and scores
        self.by_length = []
        for n in range(1, max(map(len, self.pieces)) + 1):
            own = sorted(p for p in self.prefixes if len(p) == n)
            h = _hashes(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n))
            order = np.argsort(h)
            found = [self.pieces.get(own[i], (-1, 0.0)) for i in order]
            self.by_length.append((h[order], np.array([i for i, _ in found], np.int64), np.array([x for _, x in found])))

    def arcs(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end, (start, piece id or -1, score), by start."""
        n = len(unit)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        pieces, prefixes = self.pieces, self.prefixes
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                s = unit[i:j]
                if s not in prefixes:
                    break
                if s in pieces:
                    piece, score = pieces[s]
                    out[j].append((i, piece, score))
                    single |= j == i + 1
            if not single:
                out[i + 1].append((i, -1, self.unknown))
        return out

    def ids_of(self, unit: str, path: list[tuple[int, int, int]]) -> list[int]:
        out: list[int] = []
        for i, j, piece in path:
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes[b] for b in unit[i:j].encode()]
        return out

    def decode(self, ids) -> str:
        return b"".join([self.surface[i] for i in ids]).decode()[1:]


def forward(arcs: list[list[tuple[int, int, float]]]) -> tuple[list[float], list[tuple[int, int]]]:
    """Best score to each node, and the arc it comes by; of equal ones the longest."""
    best = [0.0] * len(arcs)
    by: list[tuple[int, int]] = [(0, -1)] * len(arcs)
    for j in range(1, len(arcs)):
        top = -float("inf")
        for i, piece, score in arcs[j]:
            s = best[i] + score
            if s > top:
                top, by[j] = s, (i, piece)
        best[j] = top
    return best, by


def second_loss(arcs, best: list[float], by) -> float:
    """How much the second-best path loses: the least over arcs off the best path, by scores from the start and from the end."""
    n = len(arcs) - 1
    back = [-float("inf")] * (n + 1)
    back[n] = 0.0
    on = set()
    j = n
    while j:
        on.add((by[j], j))
        j = by[j][0]
    other = -float("inf")
    for j in range(n, 0, -1):
        b = back[j]
        for i, piece, score in arcs[j]:
            s = b + score
            if s > back[i]:
                back[i] = s
            if ((i, piece), j) not in on and best[i] + s > other:
                other = best[i] + s
    return best[n] - other


def n_best(arcs, best: list[float], n: int) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """The ``n`` best segmentations by backward A-star: (score, path of (start, end, piece))."""
    end = len(arcs) - 1
    heap: list = [(-best[end], end, 0, 0.0, None)]  # of equal scores the one nearest to the start, so that ties don't fan out
    made = 1
    out = []
    while heap and len(out) < n:
        f, node, _, g, path = heapq.heappop(heap)
        if node == 0:
            steps = []
            while path:
                steps.append(path[0])
                path = path[1]
            out.append((-f, steps))
            continue
        for i, piece, score in arcs[node]:
            heapq.heappush(heap, (-(g + score + best[i]), i, made, g + score, ((i, node, piece), path)))
            made += 1
    return out


class _Index(dict):
    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class Encoder:
    """Encodes texts and remembers the units it has met."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.vocabulary, self.n = vocabulary, n
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.ids, self.start, self.score, self.loss = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0)
        self.several: dict[str, list] = {}

    def _learn(self) -> None:
        done = len(self.score)
        if done == len(self.index):
            return
        new = newest(self.index, len(self.index) - done)
        short = [i for i, u in enumerate(new) if len(u) <= TOGETHER]
        sizes, scores, losses = np.zeros(len(new), np.int64), np.zeros(len(new)), np.zeros(len(new))
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(new)
        if short:
            flat, sizes[short], scores[short], losses[short] = self._together([new[i] for i in short])
        for i in [i for i, u in enumerate(new) if len(u) > TOGETHER]:
            arcs = self.vocabulary.arcs(new[i])
            best, by = forward(arcs)
            path, j = [], len(new[i])
            while j:
                k, piece = by[j]
                path.append((k, j, piece))
                j = k
            ids[i] = np.array(self.vocabulary.ids_of(new[i], path[::-1]), np.int32)
            sizes[i], scores[i], losses[i] = len(ids[i]), best[-1], second_loss(arcs, best, by)
        if len(short) < len(new):
            at = np.concatenate([[0], np.cumsum(sizes[short])]) if short else [0]
            for k, i in enumerate(short):
                ids[i] = flat[at[k] : at[k + 1]]
            flat = np.concatenate(ids)
        self.start = np.concatenate([self.start, np.cumsum(sizes) + self.start[-1]])
        self.ids = np.concatenate([self.ids, flat])
        self.score, self.loss = np.concatenate([self.score, scores]), np.concatenate([self.loss, losses])

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of many short units at once: ids one after another, how many each has, scores, losses of the second-best paths.
        The same as ``forward`` and ``second_loss``, node by node of all units together."""
        v = self.vocabulary
        size = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        unit = np.repeat(np.arange(len(units)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(codes)) - first[unit]
        left = size[unit] - place
        # arcs by length of the piece
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        starts, lengths, pieces, scores = [], [], [], []
        single = np.zeros(len(codes), bool)
        for n, (known, piece, score) in enumerate(v.by_length, 1):
            keep = left[at] >= n
            at, h = at[keep], h[keep]
            h = _further(h, codes[at + n - 1])
            where = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[where] == h
            at, h, where = at[hit], h[hit], where[hit]
            whole = piece[where] >= 0
            starts.append(at[whole])
            pieces.append(piece[where[whole]])
            scores.append(score[where[whole]])
            lengths.append(np.full(len(starts[-1]), n))
            if n == 1:
                single[starts[-1]] = True
            if not len(at):
                break
        bare = np.flatnonzero(~single)
        char = np.concatenate([*starts, bare])
        length = np.concatenate([*lengths, np.ones(len(bare), np.int64)])
        piece = np.concatenate([*pieces, np.full(len(bare), -1)])
        score = np.concatenate([*scores, np.full(len(bare), v.unknown)])
        tail = char + unit[char]  # a unit of n characters has n + 1 nodes
        head = tail + length
        origin, goal = first + np.arange(len(units)), first + np.arange(len(units)) + size

        def swept(rank: np.ndarray, to: np.ndarray, tie: np.ndarray, of: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Best score at each node from ``begin`` nodes on, taking arcs by ``rank``, and the arc it comes by (of equal ones that with the least ``tie``)."""
            best, by = np.full(len(codes) + len(units), -np.inf), np.full(len(codes) + len(units), -1)
            best[begin] = 0.0
            order = np.argsort((rank << 44) | (to << 7) | tie)
            steps = np.searchsorted(rank[order], np.arange(int(rank.max()) + 2))
            for a, b in zip(steps[:-1], steps[1:], strict=True):
                if a == b:
                    continue
                o = order[a:b]
                value = best[of[o]] + score[o]
                new = np.append(True, to[o][1:] != to[o][:-1])
                seg = np.flatnonzero(new)
                top = np.maximum.reduceat(value, seg)
                equal = np.flatnonzero(value == top[np.cumsum(new) - 1])
                owner = to[o[equal]]
                pick = equal[np.append(True, owner[1:] != owner[:-1])]
                best[to[o[pick]]], by[to[o[pick]]] = value[pick], o[pick]
            return best, by

        best, by = swept(place[char] + length, head, TOGETHER - length + 1, tail, origin)
        back, _ = swept(TOGETHER - place[char], tail, length, head, goal)
        on = np.zeros(len(char), bool)
        node = goal
        while len(node):
            arc = by[node]
            on[arc] = True
            node = tail[arc]
            node = node[place[char[arc]] > 0]
        by_tail = np.argsort(tail)
        other = np.where(on, -np.inf, best[tail] + score + back[head])[by_tail]
        other = np.maximum.reduceat(other, np.searchsorted(tail[by_tail], origin))
        path = by_tail[on[by_tail]]
        wide = np.ones(len(path), np.int64)
        unknown = np.flatnonzero(piece[path] < 0)
        spelled = [[v.bytes[b] for b in chr(codes[char[path[i]]]).encode()] for i in unknown]
        wide[unknown] = [len(x) for x in spelled]
        flat = np.repeat(piece[path], wide).astype(np.int32)
        if spelled:
            flat[flat < 0] = np.array([b for x in spelled for b in x], np.int32)
        return flat, np.add.reduceat(wide, np.searchsorted(unit[char[path]], np.arange(len(units)))), best[goal], best[goal] - other

    def _best_of_unit(self, unit: str) -> list[tuple[float, list[int]]]:
        if unit not in self.several:
            arcs = self.vocabulary.arcs(unit)
            found = [(s, self.vocabulary.ids_of(unit, p)) for s, p in n_best(arcs, forward(arcs)[0], self.n)]
            w = self.index[unit]
            first = self.ids[self.start[w] : self.start[w + 1]].tolist()
            # of equal scores the one that encoding takes comes first
            self.several[unit] = [(found[0][0], first), *(x for x in found if x[1] != first)][: self.n]
        return self.several[unit]

    def _alternatives(self, units: list[str], which: np.ndarray, full: bool) -> list[tuple[float, list[tuple[int, int, list[int]]], list[int] | None]]:
        """The N best of a text: (score, changes, ids). Changes are what differs from the best: from a place among its ids so many of them are replaced."""
        total = float(self.score[which].sum())
        loss = self.loss[which]
        k = min(self.n - 1, len(loss))
        at = np.sort(np.argpartition(loss, k - 1)[:k]) if k else np.zeros(0, np.int64)
        own = [self._best_of_unit(units[a]) for a in at]
        base = [o[0][0] for o in own]
        sums = sorted((sum(b - o[c][0] for b, o, c in zip(base, own, choice, strict=True)), choice) for choice in product(*(range(len(o)) for o in own)))
        out = []
        pieces = np.concatenate([[0], np.cumsum(self.start[which + 1] - self.start[which])])
        for lost, choice in sums[: self.n]:
            ids, changes = None, [(int(pieces[a]), int(pieces[a + 1] - pieces[a]), o[c][1]) for a, o, c in zip(at, own, choice, strict=True) if c]
            if full:
                swap = {int(a): o[c][1] for a, o, c in zip(at, own, choice, strict=True)}
                ids = [x for i, w in enumerate(which) for x in (swap[i] if i in swap else self.ids[self.start[w] : self.start[w + 1]].tolist())]
            out.append((total - lost, changes, ids))
        return out

    def encode(self, texts: list[str | None], full: bool = False) -> tuple[pa.Array, list[float], list[list[float]], list[list[list[int]]], list[list[list[tuple]]]]:
        """Ids (a list array), scores, the N best scores, with ``full`` the N best id lists, and what the second to the N-th best change."""
        if len(self.index) > MEMO_UNITS:
            self._reset()
        split = [_UNITS.findall(" " + t) if t else [] for t in texts]
        which = [np.fromiter(map(self.index.__getitem__, u), np.int64, len(u)) for u in split]
        self._learn()
        scores, several, lists, changed = [], [], [], []
        for units, w in zip(split, which, strict=True):
            scores.append(float(self.score[w].sum()))
            best = self._alternatives(units, w, full) if units else [(0.0, [], [])]
            several.append([s for s, _, _ in best])
            lists.append([ids for _, _, ids in best] if full else [])
            changed.append([c for _, c, _ in best[1:]])
        flat = np.concatenate(which) if which else np.zeros(0, np.int64)
        length = self.start[flat + 1] - self.start[flat]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(self.start[flat] - upto[:-1], length) + np.arange(upto[-1])]
        bounds = upto[np.cumsum([0, *(len(w) for w in which)])]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), scores, several, lists, changed


def _changes(rows: list[list[list[tuple[int, int, list[int]]]]]) -> pa.Array:
    """Arrow form of the changes of many texts, from flat lists."""
    ranks = [c for r in rows for c in r]
    each = [x for c in ranks for x in c]
    ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(x[2]) for x in each)]).astype(np.int32), pa.array([i for x in each for i in x[2]], pa.int32()))
    parts = pa.StructArray.from_arrays([pa.array([x[0] for x in each], pa.int32()), pa.array([x[1] for x in each], pa.int32()), ids], names=["at", "n", "ids"])
    inner = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ranks)]).astype(np.int32), parts)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), inner)


def encode(docs: DataFrame, model_path: str | None = None, n: int = N_BEST, full: bool = False) -> DataFrame:
    """``docs`` with ids, n_pieces, score, best_scores (the N best), changes (of the second to the N-th best: from place ``at`` among the ids ``n`` of them become others), same (whether the ids decode to the text), and with
    ``full`` also alternatives (the N best id lists)."""
    prepare(docs.sparkSession)
    added = {"ids": "array<int>", "n_pieces": "long", "score": "double", "best_scores": "array<double>", "same": "boolean", "changes": "array<array<struct<at:int,n:int,ids:array<int>>>>"} | ({"alternatives": "array<array<int>>"} if full else {})
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path or default_model()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, n)
        surface = np.array([len(s) for s in shared.value.surface])
        joined, start = b"".join(shared.value.surface), np.concatenate([[0], np.cumsum(surface)])
        letters = np.frombuffer(joined, np.uint8)

        def spelled(ids: np.ndarray) -> bytes:
            length = surface[ids]
            upto = np.concatenate([[0], np.cumsum(length)])
            return letters[np.repeat(start[ids] - upto[:-1], length) + np.arange(upto[-1])].tobytes()

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                texts = b.column("text").to_pylist()
                ids, scores, several, lists, changed = encoder.encode(texts, full)
                sizes = np.diff(ids.offsets.to_numpy())
                same = [spelled(x.values.to_numpy()).decode()[1:] == (t or "") for x, t in zip(ids, texts, strict=True)]
                columns = [ids, pa.array(sizes, pa.int64()), pa.array(scores, pa.float64()), pa.array(several, pa.list_(pa.float64())), pa.array(same), _changes(changed)]
                if full:
                    columns.append(pa.array(lists, pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *added])

    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items()))
    return docs.mapInArrow(made, T.StructType([*docs.schema.fields, *more.fields]))


def decode(encoded: DataFrame, model_path: str | None = None, column: str = "ids") -> DataFrame:
    """``encoded`` with decoded, the text of the ids; null ids give a null text."""
    prepare(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_path or default_model()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else shared.value.decode(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    rest = encoded.drop("decoded")
    return rest.mapInArrow(made, T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())]))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_pieces", "score", "best_scores", F.col("same").alias("round_trip"), "ids", "changes")
