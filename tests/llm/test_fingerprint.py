import hashlib
import itertools
import random

import xxhash

from marlstone.llm import fingerprint as L


M = (1 << 64) - 1


def mix(h):
    for _ in range(2):
        h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & M
    return h ^ (h >> 32)


def parsed(symbols):
    """One level of parsing, symbol by symbol: runs, three rounds of coin tossing, phrases that begin at peaks."""
    names = []
    for s, run in itertools.groupby(symbols):
        n = len(list(run))
        names.append(s if n == 1 else mix((s * 0x9E3779B97F4A7C15 + n) & M))
    label = names
    for _ in range(3):
        out = []
        for i, s in enumerate(label):
            differ = s ^ label[i - 1] if i else 1
            low = (differ & -differ).bit_length() - 1
            out.append(2 * low + (s >> low & 1))
        label = out
    begins = [i for i in range(len(label)) if i == 0 or (label[i] > label[i - 1] and (i + 1 == len(label) or label[i] > label[i + 1]))]
    phrases = [names[a:b] for a, b in zip(begins, [*begins[1:], len(names)], strict=True)]
    return [mix(sum(s * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, s in enumerate(p)) & M) for p in phrases]


def levels(text):
    one = parsed([ord(c) for c in text]) if text else []
    return one, parsed(one) if one else []


def brute_signature(text):
    return [sorted({h >> 32 for h in level})[:keep] for level, keep in zip(levels(text), (16, 64), strict=True)]


def brute_likeness(a, b):
    """The share of common names among the least of the union that both fingerprints are sure to know."""
    level = 1 if min(len(a[1]), len(b[1])) >= 8 else 0
    x, y, keep = set(a[level]), set(b[level]), (16, 64)[level]
    if not x or not y:
        return float(x == y)
    union = sorted(x | y)
    if keep in (len(x), len(y)):
        union = union[:keep]
    return len(x & y & set(union)) / len(union)


def check(rows, got):
    place = lambda r: (r[0] is not None, r[0] or 0, -signed(r[1] or ""))
    order, want = sorted(rows, reverse=True, key=place), []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        own, other, nxt = (brute_signature(t) for t in (text, changed, following))
        name = lambda s: "-".join("".join(f"{h:08x}" for h in level) for level in s)
        want.append((repr(doc), len(text), hashlib.sha256(changed.encode()).hexdigest(), name(own), name(other), 1.0 if text == changed else brute_likeness(own, other), 1.0 if text == following else brute_likeness(own, nxt)))
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >> 63 else h


def test_query_against_brute_force(documents):
    pick = random.Random(2)
    rows = [(i * 7, "".join(pick.choice("abcdé 漢") * pick.choice([1, 1, 1, 4]) for _ in range(pick.randrange(200)))) for i in range(60)] + [(1000, None), (1001, ""), (1002, "a" * 500)]
    check(rows, L.fingerprints(documents(rows)).collect())


def test_repeated_and_null_ids(documents, awkward):
    rows = [*awkward, *[(None, "same again and again")] * 40, *[(9, f"text {i % 5} of one id") for i in range(30)]]
    check(rows, L.fingerprints(documents(rows).repartition(5)).collect())


def test_likeness_is_close_to_that_of_all_phrases():
    """Against the Jaccard likeness of the texts' whole sets of phrases: 64 names leave a standard error of 0.06 at most."""
    pick = random.Random(7)
    error = []
    for i in range(60):
        a = "".join(pick.choice("abcdefgh ") for _ in range(6000))
        cut = 100 * i
        b = "".join(pick.choice("abcdefgh ") for _ in range(cut)) + a[cut:]
        x, y = (set(levels(t)[1]) for t in (a, b))
        error.append(L.likeness(*L.signatures([a, b])) - len(x & y) / len(x | y))
    assert max(map(abs, error)) < 0.2 and abs(sum(error) / len(error)) < 0.02


def test_very_long_texts(documents):
    pick = random.Random(8)
    unit = "".join(pick.choice("abcdefgh ") for _ in range(200_000))
    rows = [(3, unit * 100), (2, "x" * 1_000_000), (1, unit * 100)]
    got = {r.doc_id: r for r in L.fingerprints(documents(rows)).collect()}
    assert got[3].n_chars == 20_000_000 and got[3].fingerprint == got[1].fingerprint and got[2].n_chars == 1_000_000 and got[1].near_next == 1.0


def test_equal_substrings_share_interior_phrases():
    pick = random.Random(4)
    body = "".join(pick.choice("abcdefgh ") for _ in range(2000))
    a, b = L.signatures(["xyz" + body, "other start " + body + " tail"])
    assert L.likeness(a, b) > 0.85
    c, d = L.signatures([body, "".join(pick.choice("abcdefgh ") for _ in range(2000))])
    assert L.likeness(c, d) < 0.1 and L.likeness(c, c) == 1.0
    assert [x.tolist() for x in L.from_text(L.as_text(c))] == [x.tolist() for x in c]


def test_labels_differ_and_stay_small():
    import numpy as np

    names = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    label = L._tossed(names, np.array([0]))
    assert label.max() < 8 and (label[1:] != label[:-1]).all()


def test_batches_do_not_matter():
    pick = random.Random(6)
    texts = ["".join(pick.choice("ab ") for _ in range(pick.randrange(50))) for _ in range(50)]
    together = [L.as_text(s) for s in L.signatures(texts)]
    assert together == [L.as_text(L.signatures([t])[0]) for t in texts]


def test_awkward_rows(documents, awkward):
    got = L.fingerprints(documents(awkward)).collect()
    assert len(got) == len(awkward) and len({r.fingerprint for r in got if r.n_chars == 22}) == 1
    assert L.fingerprints(documents([])).count() == 0
    one = L.fingerprints(documents([(5, "only one document")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"only one doonly ").hexdigest() or one.n_chars == 17
