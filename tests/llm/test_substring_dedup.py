import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marlstone.llm import substring_dedup as D


def place(row):
    """Documents by id, null ids last; equal ids by the signed XXH64 of their text."""
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
    return (2**63 if row[0] is None else row[0], h - 2**64 if h >> 63 else h)


def brute(rows, window):
    """(id, words, removed, kept, maximal repeated stretches) by a set of all windows."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=place):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        edges = [i for i in range(len(w) + 1) if (i < len(w) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), list(zip(edges[::2], edges[1::2], strict=True))))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, [tuple(p) for p in r.passages]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [3, 20])
def test_against_brute_force(documents, window):
    pick = random.Random(window)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(pick.choice("abc") + str(pick.randrange(3)) for _ in range(pick.randrange(60))) + pick.choice(["", f" {passage}", f"\n{passage} {passage}"])) for i in range(80)]
    got = D.dedup(documents(rows).repartition(5), window)
    assert rows_of(got) == brute(rows, window)
    assert all(r.score == "x" for r in got.collect())


def found_in(rows, window, heavy):
    """Windows that the operator's parts find, over three tasks and one bin."""
    gram, out, parts = min(D.GRAM, window), set(), []
    for task in range(3):
        mine = rows[task::3]
        b = pa.RecordBatch.from_arrays([pa.array([d for d, _ in mine], pa.int64()), pa.array([0] * len(mine), pa.int64()), pa.array([t for _, t in mine])], names=["doc_key", "copy", "text"])
        for v, bounds, doc, copy in D._chunks([b], window):
            s, _ = D.anchored(v, bounds, doc, copy, heavy, window, gram)
            late = D.met_before(s, window)
            out |= {(int(s.doc[i]), int(s.low[i]) + k) for i in np.flatnonzero(late) for k in range(int(s.many[i]))}
            parts.append(s.taken(np.flatnonzero(~late), window))
    whole = D.Suffixes(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("doc", "copy", "low", "many", "left", "words")))
    doc, _, start = D.tree_repeats(whole, window, gram)
    return out | set(zip(doc.tolist(), start.tolist(), strict=True))


def repeated(rows, window):
    seen, out = set(), set()
    for doc, text in sorted(rows):
        w = text.split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                out.add((doc, i))
            seen.add(k)
    return out


@pytest.mark.parametrize("kind", ["no heavy prefix", "all heavy", "some heavy", "all names collide"])
@pytest.mark.parametrize("window", [3, 4, 7, 20])
def test_tree_against_brute_force(window, kind, monkeypatch):
    heavy = np.zeros(1 << 16, bool)
    heavy[:: {"all heavy": 1, "some heavy": 2}.get(kind, 1 << 17)] = kind in ("all heavy", "some heavy")
    if kind == "all names collide":
        monkeypatch.setattr(D, "mixed", lambda x: x * np.uint64(0))
    pick = random.Random(window)
    passage = [f"p{i}" for i in range(40)]
    for letters in ("a", "ab", "abcdefgh"):
        rows = []
        for i in range(30):
            w = [pick.choice(letters) + pick.choice(["", "1"]) for _ in range(pick.randrange(50))]
            rows.append((i, " ".join(w + (passage[pick.randrange(10) : pick.randrange(25, 41)] + w[:6] if i % 2 else []))))
        pick.shuffle(rows)
        assert found_in([*rows, (90, " ".join(passage))], window, heavy) == repeated([*rows, (90, " ".join(passage))], window)


def test_frequent_beginnings_do_not_fill_a_bin(documents):
    pick = random.Random(5)
    word = lambda: f"w{pick.randrange(5000)}"
    rows, bins = [], 8
    for i in range(300):  # each of 300 first words, and the same three words after it, begins ten different passages
        rows += [(10 * i + j, f"{word()} {word()} first{i} same same same {' '.join(word() for _ in range(80))}") for j in range(10)]
    rows += [(9000 + j, f"hot hot hot hot {' '.join(word() for _ in range(30))} " * 3) for j in range(600)]
    docs = D.numbered(documents(rows))
    heavy = np.zeros(D.buckets_for(bins), bool)
    heavy[D.heavy_buckets(docs, 20, 4, bins)] = True
    key = []
    for b in docs.select("doc_key", "copy", "text").toArrow().to_batches():
        for v, bounds, doc, copy in D._chunks([b], 20):
            key.append(D.anchored(v, bounds, doc, copy, heavy, 20, 4)[1])
    load = np.bincount((D.mixed(np.concatenate(key)) % np.uint64(bins)).astype(np.int64), minlength=bins)
    assert load.max() <= 2 * load.mean()


def test_awkward_rows(documents, awkward):
    rows = [*awkward, *[(30, "same text " * 20)] * 3, (31, "same text " * 20), (32, "one two three " * 20), (32, "one two three " * 21), (None, "one two three " * 9)]
    got = D.dedup(documents(rows))
    assert rows_of(got) == brute(rows, 20)
    assert D.dedup(documents([])).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(next(r.kept for r in got.collect() if r.doc_id == 2).encode()).hexdigest()


def test_very_long_texts(documents):
    pick = random.Random(6)
    long = " ".join(f"n{pick.randrange(10**6)}" for _ in range(2_500_000))  # some 20 million characters
    w = long.split()
    rows = [(1, long), (2, " ".join(w[1_000_000:1_000_050])), (3, "x" * 1_000_000 + " y"), (4, " ".join(w[10:28]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in D.dedup(documents(rows)).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (len(w), 0), 2: (50, 50), 3: (2, 0), 4: (18, 0)}
