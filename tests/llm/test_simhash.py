import random
import re

import numpy as np
import pytest
import xxhash

from marlstone.llm import simhash as S


def fingerprint(text):
    w = [x for x in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    names = sorted(set(fps))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    return {f: find(f) for f in names}


def test_covering_masks_cover_every_pair():
    masks = S.covering_masks()
    assert len(masks) == 7 and all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def _links(spark, fps):
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    tied = {r.node: r.root for r in S.components(S.links(df)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    groups = {}
    for f, s in zip(fps, signed, strict=True):
        groups.setdefault(tied.get(s, s), set()).add(f)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("split", [40, 4096])
def test_links_against_all_pairs(spark, split, monkeypatch):
    monkeypatch.setattr(S, "SPLIT", split)
    pick = random.Random(9)
    fps = {pick.getrandbits(64) for _ in range(50)} | {0}
    for base in list(fps)[:20]:
        for _ in range(20):  # chains and dense groups, which also fill large buckets
            base ^= 1 << pick.randrange(64)
            base ^= 1 << pick.randrange(64)
            fps.add(base)
    base = pick.getrandbits(64)
    fps |= {base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(0, 12)}
    want = {}
    for f, r in brute_components(fps).items():
        want.setdefault(r, set()).add(f)
    assert _links(spark, sorted(fps)) == {frozenset(g) for g in want.values()}


def test_query(documents, awkward):
    rows = [*awkward, (50, "The cat sat on the mat and slept"), (51, "the CAT sat on the mat and slept"), (52, "something else entirely here now")]
    got = S.near_duplicates(documents(rows)).collect()
    comp = brute_components([fingerprint(t) for _, t in rows])
    least = {}
    for d, t in rows:
        r = comp[fingerprint(t)]
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted(repr((d, fingerprint(t), least[comp[fingerprint(t)]])) for d, t in rows)
    assert sorted(repr((r.doc_id, int(np.int64(r.fp).view(np.uint64)), r.component_id)) for r in got) == want
    assert S.near_duplicates(documents([])).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 100)], "a long, b long")
    assert {r.node: r.root for r in S.components(edges).collect()} == {i: 0 for i in range(1, 61)} | {101: 100, 200: 100}


@pytest.mark.parametrize("at_once", [1_000_000, 0])
def test_components_at_once_and_in_rounds(spark, monkeypatch, at_once):
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    pick = random.Random(31)
    edges = [(pick.randrange(-300, 300), pick.randrange(-300, 300)) for _ in range(250)] + [(5000, 5000), (2**62, -(2**62)), (7, 8), (8, 7), (7, 8)]
    edges += [(1000 + 7 * i % 100, 1000 + 7 * (i + 1) % 100) for i in range(80)]
    root = {x: x for e in edges for x in e}
    while changed := [(a, b) for a, b in edges if root[a] != root[b]]:
        for a, b in changed:
            root[a] = root[b] = min(root[a], root[b])
    got = S.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, r) for x, r in root.items() if x != r)
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_jobs_for_few_links(spark):
    """Each job leaves something in the driver's memory; a chain this long takes many rounds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.sparkContext.setJobGroup("links", "links")
    try:
        assert S.components(edges).count() == 200
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("links")) <= 12


def test_very_long_texts(documents):
    pick = random.Random(12)
    long = " ".join(f"w{pick.randrange(10**5)}" for _ in range(3_000_000))  # some 20 million characters
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(documents(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_blocks_of_shingles_do_not_matter(monkeypatch):
    words = S.words_of("one two three four five six seven eight nine ten " * 3)
    whole = S.shingle_hashes(words).tolist()
    monkeypatch.setattr(S, "BLOCK", 4)
    assert S.shingle_hashes(words).tolist() == whole and len(whole) == 28
