import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import language_model as L
from marlstone.llm.common import held_out
from marlstone.llm.elias_fano import EliasFano


@pytest.mark.parametrize(("n", "top"), [(1, 5), (10, 10), (1000, 1000), (5000, 2**63), (50000, 2**20), (3, 2**64 - 1)])
def test_elias_fano(n, top):
    pick = np.random.default_rng(n)
    v = np.unique(pick.integers(0, top, n, dtype=np.uint64))
    e = EliasFano.of(v)
    assert (e.access(np.arange(len(v))) == v).all()
    q = np.concatenate([v, pick.integers(0, top, 500, dtype=np.uint64)])
    at = np.searchsorted(v, q)
    assert (e.find(q) == np.where((at < len(v)) & (v[np.minimum(at, len(v) - 1)] == q), at, -1)).all()
    steps = np.sort(pick.integers(0, 50, 300).astype(np.uint64))
    a, b = EliasFano.of(steps).access_pairs(np.arange(299))
    assert (a == steps[:-1].astype(np.int64)).all() and (b == steps[1:].astype(np.int64)).all()
    assert len(EliasFano.of(np.zeros(0, np.uint64)).find(q)) == len(q)


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


class Brute:
    """Interpolated absolute discounting over Counter tables."""

    def __init__(self, texts):
        rows = [tokens(t) for t in texts]
        self.grams = {k: Counter(tuple(r[i : i + k]) for r in rows for i in range(len(r) - k + 1)) for k in (1, 2, 3)}
        self.kept = {1: self.grams[1]} | {k: {g: n for g, n in self.grams[k].items() if n >= L.MIN_COUNT} for k in (2, 3)}
        self.next = {k: defaultdict(list) for k in (2, 3)}
        for k in (2, 3):
            for g, n in self.kept[k].items():
                self.next[k][g[:-1]].append(n)
        self.n, self.v = sum(self.grams[1].values()), len(self.grams[1])

    def base(self, w):
        return (self.grams[1][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, w, before):
        p = self.base(w)
        for k in (2, 3):
            c = tuple(before[len(before) - k + 1 :])
            if len(c) < k - 1 or c not in self.kept[k - 1]:
                break
            total = self.grams[k - 1][c]
            n = self.kept[k].get((*c, w), 0)
            p = (n - L.DISCOUNT if n else 0) / total + (1 - sum(x - L.DISCOUNT for x in self.next[k][c]) / total) * p
        return p


@pytest.mark.parametrize("entries", [L.SHARD_ENTRIES, 3])
def test_scores_against_brute_force(documents, awkward, monkeypatch, entries):
    monkeypatch.setattr(L, "SHARD_ENTRIES", entries)  # 3: contexts go on over several shards
    pick = random.Random(5)
    rows = [*awkward, *[(100 + i, " ".join(pick.choice("a b c d e the of x1 X2".split()) for _ in range(pick.randrange(40)))) for i in range(120)]]
    docs = documents(rows)
    model = L.fit(docs.where(~held_out(5)))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    brute = Brute([t for d, t in rows if not held(d)])
    assert (model.tokens, model.words) == (brute.n, brute.v) and len(model.levels[1]) > (entries == 3) * 10
    got = L.score(docs, model).collect()
    want = []
    for d, t in rows:
        w = tokens(t)
        want.append((repr(d), len(w), sum((x,) in brute.grams[1] for x in w), sum(math.log10(brute.base(x)) for x in w), sum(math.log10(brute.p(x, w[:i])) for i, x in enumerate(w))))
    for r, (d, n, known, base, score) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.base_score)), sorted(want, key=lambda x: (x[0], x[3])), strict=True):
        assert (repr(r.doc_id), r.n_tokens, r.n_known) == (d, n, known) and r.base_score == pytest.approx(base, abs=1e-9)
        assert r.score == pytest.approx(score, abs=0.03 * n + 1e-9)  # probabilities are kept in 8 bits


def test_memory_gives_what_the_search_gives(monkeypatch):
    monkeypatch.setattr(L, "MEMORY", 5)
    memory, pick, asked = L._Memory((np.int64, np.float64)), np.random.default_rng(1), []

    def search(keys):
        asked.append(len(keys))
        assert (np.diff(keys) > 0).all()
        return [keys * 3, keys / 7]

    for _ in range(50):
        keys = pick.integers(-40, 40, 60) if len(asked) % 2 else pick.integers(0, 9, 60)
        a, b = memory.through(keys, search)
        assert (a == keys * 3).all() and (b == keys / 7).all()
    assert sum(asked) < 50 * 60 / 2


def test_probabilities_sum_to_one(documents):
    """Over all training words, the end and one unknown word, after contexts of one and two words; 8 bits leave a few per cent."""
    pick = random.Random(6)
    rows = [(i, " ".join(pick.choice("a b c d e f g h".split()) for _ in range(30))) for i in range(60)]
    model = L.fit(documents(rows))
    trie = model.opened()
    hashes, _ = L.Tokens().read(pa.array(["a b c d e f g h unknown"]))
    word, count = trie.words(hashes)
    p = (count + 0.5) / (model.tokens + 0.5 * (model.words + 1))
    assert p.sum() == pytest.approx(1) and word[-2] == -1
    a, b = word[0], word[1]
    n = len(word)
    two, alpha, rest = trie.extend(1, np.full(n, b), word)
    p2 = alpha + rest * p
    both = trie.extend(1, np.array([a]), np.array([b]))[0][0]
    _, alpha, rest = trie.extend(2, np.full(n, both), word)
    assert p2.sum() == pytest.approx(1, abs=0.04) and (alpha + rest * p2).sum() == pytest.approx(1, abs=0.06)


def test_very_long_texts(documents):
    rows = [(1, "a b c " * 3_500_000), (2, "w" * 1_000_000)]
    docs = documents(rows)
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in L.score(docs, L.fit(docs)).collect()}
    assert got == {1: (10_500_001, 10_500_001), 2: (2, 2)}


def test_nothing_to_learn_from(documents):
    model = L.fit(documents([]))
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in L.score(documents([(1, None)]), model).collect()] == [(1, 0, 0.0, 0.0)]
    assert L.score(documents([]), model).count() == 0
