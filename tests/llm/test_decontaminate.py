import random
import re
from collections import Counter

import pytest

from marlstone.llm import decontaminate as D


def words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(len(x), 10)
        for j in range(len(x) - n + 1 if x else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture
def items(spark):
    rows = [(10, " ".join(f"w{i}" for i in range(25))), (2, "Short, item here!"), (3, None), (4, "..."), (5, "a b a b a b a b a b a b"), (6, "Short item here"), (7, " ".join(f"w{i}" for i in range(5, 20)) + " z"), (8, "lacking w3 ghostword")]
    return rows, spark.createDataFrame([(i, t) for i, t in rows], "item_id long, text string")


def test_against_brute_force(documents, awkward, items):
    rows, table = items
    pick = random.Random(1)
    docs = [*awkward, (100, "x short ITEM here y short item here"), (101, "b a b a b a b a b a b a b a"), (102, " ".join(f"w{i}" for i in range(4, 16))), (103, "w9 " * 12)]
    for n in range(40):
        a = pick.randrange(20)
        docs.append((200 + n, " ".join(f"W{i}" for i in range(a, a + pick.randrange(14))) + " é9 end"))
    got = D.mark(documents(docs), table).collect()
    assert sorted((repr((r.doc_id, r.text)), r.n_words, r.n_hit, list(r.items)) for r in got) == sorted((repr(d), *brute(d[1], rows)) for d in docs)
    assert all(r.n_items == len(r.items) and r.score == "x" for r in got)


def test_proximity(documents):
    docs = D.keyed(documents([(1, "alpha x x beta"), (2, "beta x alpha"), (3, "alpha x x x beta"), (4, "alpha")]))
    names = {r.doc: r.doc_id for r in docs.collect()}
    assert sorted((names[r.doc], r.at) for r in D.proximity_matches(D.postings(docs), ["alpha", "beta"], 3).collect()) == [(1, 0), (2, 2)]


def brute_near(docs, rows):
    """For each row, the number of items whose three rarest terms stand within ten words of the rarest, by loops over all positions."""
    texts = [words(t) for _, t in docs]
    count = Counter(w for t in texts for w in t)
    out = [0] * len(docs)
    for _, text in rows:
        x = words(text)
        rare = sorted({w for w in x if count[w]}, key=lambda w: (count[w], x.index(w)))[: D.NEAR]
        for i, t in enumerate(texts):
            at = {w: [p for p, y in enumerate(t) if y == w] for w in rare}
            out[i] += bool(rare) and any(all(any(abs(p - q) <= D.SLOP for q in at[w]) for w in rare) for p in at[rare[0]])
    return out


def test_near_items_against_brute_force(documents, items):
    rows, table = items
    pick = random.Random(7)
    docs = [(i, " ".join(f"w{pick.randrange(26)}" if pick.random() < 0.5 else pick.choice(["x", "short", "item", "a"]) for _ in range(pick.randrange(90)))) for i in range(80)]
    got = {r.doc_id: r.n_near for r in D.mark(documents(docs), table).collect()}
    want = brute_near(docs, rows)
    assert [got[d] for d, _ in docs] == want and len(set(want)) > 2


def test_very_long_texts(documents, items):
    rows, table = items
    long = "v w x y z " * 2_000_000
    docs = [(1, long + rows[0][1]), (2, "q" * 1_000_000 + " short item here")]
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in D.mark(documents(docs), table).collect()}
    assert got == {1: (10_000_025, 25, ["10", "7"]), 2: (4, 3, ["2", "6"])}


def test_empty_tables(documents, items):
    rows, table = items
    assert D.mark(documents([]), table).count() == 0
    assert {(r.n_hit, r.n_items) for r in D.mark(documents([(1, "w1 w2")]), table.limit(0)).collect()} == {(0, 0)}


def test_no_python_in_the_plan(documents, items):
    plan = D.mark(documents([(1, "x")]), items[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
