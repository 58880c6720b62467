import math
import random
import re
import time

import pytest
import regex
import xxhash

from marlstone.llm import pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns(documents, awkward):
    pick = random.Random(8)
    texts = ["a@b.c_d@e.f", "x..y@@z.com a@b a@b.c@d.e", "1.2.3.4.5.6.7.8 0000.1.2.255 256.1.1.1 1.2.3", "+1 (555) 123-4567 +1.2 +123456789012345678", "4111 1111 1111 1111-4111111111111111 4111--1", "é a@b.co 😀 x@y.z " * 3, "12 " * 5000, "1.1.1.1" * 500, "+" * 3000, "a" * 50000, "9" * 50000]
    texts += ["".join(pick.choice("0123456789.@+- ()ab_é") for _ in range(60)) for _ in range(150)]
    rows = [*awkward, *[(100 + i, t) for i, t in enumerate(texts)]]
    for r in pii.find(documents(rows)).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == brute(r.text), r.text
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans)) and r.score == "x"


def brute_terms(texts, support=pii.SUPPORT, max_bits=pii.MAX_BITS):
    """Places of disclosing terms in each text, by loops over all texts."""
    texts = set(texts)
    beside, raw, holds = {}, {}, {}
    for t in sorted(texts):
        for term in {m[0].lower() for m in regex.finditer(r"\p{L}{2,}", t)}:
            holds.setdefault(term, set()).add(t)
        clusters = []
        for start, kind, end in brute(t):
            if clusters and start < clusters[-1][1]:
                clusters[-1][1] = max(clusters[-1][1], end)
            else:
                clusters.append([start, end, []])
            clusters[-1][2].append((kind, t[start:end].lower()))
        edges = [0, *(x for c in clusters for x in c[:2]), len(t)]
        gaps = [[m[0].lower() for m in regex.finditer(r"\p{L}{2,}", t[a:b])] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        for i, (_, _, entities) in enumerate(clusters):
            around = (tuple(gaps[i][-pii.CONTEXT :]), tuple(gaps[i + 1][: pii.CONTEXT]))
            for entity in entities:
                for term in {*around[0], *around[1]}:
                    beside.setdefault((entity, term), {}).setdefault(around, set()).add(t)
                    raw.setdefault((entity, term), set()).add(t)
    out = set()
    for (entity, term), contexts in beside.items():
        names = {h: t for t in raw[entity, term] for h in [signed(t)]}
        both = len({min(signed(t) for t in c) for c in contexts.values()} & set(names))
        every = len(holds[term]) - len(raw[entity, term]) + both
        if both >= support and -math.log2(both / every) <= max_bits:
            out.add(term)
    return {t: [(m.start(), m.end()) for m in regex.finditer(r"\p{L}{2,}", t) if m[0].lower() in out] for t in texts}


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >> 63 else h


@pytest.fixture
def revealing():
    pick = random.Random(3)
    noise = lambda: " ".join("".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    told = [(i, f"{noise()} gardener Zebulon wrote to zeb@farm.example today {noise()}") for i in range(6)]
    other = [(100 + i, f"{noise()} gardener met today {noise()} user{i}@mail.example {noise()}") for i in range(40)]
    return told + other


def test_terms_that_reveal_an_entity(documents, revealing):
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == 4] for r in pii.find(documents(revealing)).collect()}
    assert all("Zebulon" in got[i] and "gardener" not in got[i] and "today" not in got[i] for i in range(6))
    assert all(not got[100 + i] for i in range(40))


def test_copies_are_no_evidence(documents, revealing):
    assert not [s for r in pii.find(documents([(i, revealing[0][1]) for i in range(20)])).collect() for s in r.spans if s.kind == 4]


def test_sanitise(documents, revealing):
    rows = {r.doc_id: r.text for r in pii.sanitise(documents([*revealing, (900, "no data"), (901, None), (902, "+4111 1111 1111 1111 x@y.zz")])).collect()}
    assert "[TERM] wrote to [EMAIL] today" in rows[0] and rows[900] == "no data" and rows[901] is None and rows[902] == "[PHONE] [EMAIL]" or "[EMAIL]" in rows[902]


def test_empty_and_plan(documents):
    assert pii.find(documents([])).count() == 0
    for plan in (pii.found_in(documents([(1, "x")])), pii.find(documents([(1, "x")])), pii.sanitise(documents([(1, "x")]))):
        plan = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_copied_passages_do_not_hide_a_term(documents, revealing):
    pick = random.Random(4)
    noise = lambda n: " ".join("".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = f"{noise(40)} gardener Zebulon wrote to zeb@farm.example today {noise(40)}"
    rows = [(200 + i, f"{passage} {noise(5)}") for i in range(30)] + [*revealing[:2], *revealing[6:]]
    rows += [(300, f"{noise(40)} gardener Zebulon wrote to zeb@farm.example today {noise(40)} {'Zebulon ' * 50}")]
    for r in pii.find(documents(rows)).collect():
        terms = [r.text[s.start : s.end] for s in r.spans if s.kind == 4]
        assert ("Zebulon" in terms) == (not 100 <= r.doc_id < 200) and "gardener" not in terms


def term_places(df):
    return {r.text: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in df.collect()}


def test_terms_go_wherever_they_stand(documents, revealing):
    rows = [*revealing, (800, "here Zebulon is far from any address and nobody met him"), (801, "Zebulon")]
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == 4] for r in pii.find(documents(rows)).collect()}
    assert got[800] == ["Zebulon"] == got[801]


@pytest.mark.parametrize("copies", [1, 3])
def test_disclosure_against_brute_force(documents, copies):
    pick = random.Random(9)
    names = [f"{a}{b}" for a in ("Zor", "Qua", "Mir", "Tel") for b in ("bal", "xen", "vok")]
    noise = lambda n: " ".join("".join(pick.choice("abcé") for _ in range(pick.randrange(1, 4))) for _ in range(n))
    rows = []
    for i in range(150):
        parts = []
        for _ in range(pick.randrange(4)):
            k = pick.randrange(12)
            parts.append(f"{noise(pick.randrange(8))} {names[k] if pick.random() < 0.8 else ''} {noise(2)} {[f'u{k}@mail.example', f'10.0.0.{k}', f'+1 555 000 00{k:02}', f'a@b.c 1.2.3.{k}'][k % 4]} {noise(pick.randrange(7))}")
        rows.append((i, " ".join([*parts, noise(5), pick.choice([*names, *[""] * 30])])))
    rows += [(500 + i, f"{rows[3][1]} {noise(9)}") for i in range(20)]
    want = brute_terms([t for _, t in rows])
    assert sum(map(bool, want.values())) > 30
    assert term_places(pii.find(documents(rows * copies))) == want


def test_very_long_texts_take_about_linear_time(documents):
    pick = random.Random(10)
    numbers = " ".join(str(pick.randrange(10**5)) for _ in range(850_000))  # some 5 million characters
    lines = "\n".join(f"10.{i % 256}.{i // 256 % 256}.7 user{i}@mail.example" for i in range(40_000))
    rows = [(1, numbers), (2, lines), (3, "q" * 1_000_000 + " me@home.example"), (4, ("word " * 4_000_000) + "1.2.3.4")]
    start = time.time()
    got = {r.doc_id: (r.n, r.text[-20:]) for r in pii.sanitise(documents(rows)).selectExpr("doc_id", "length(text) as n", "substr(text, -20, 20) as text").collect()}
    assert got[1][0] == len(numbers) - 0 or got[1][0] < len(numbers)
    assert got[2][0] == 40_000 * len("[IP] [EMAIL]\n") - 1 and got[3] == (1_000_008, "qqqqqqqqqqqq [EMAIL]") and got[4] == (20_000_004, "ord word word word [IP]"[-20:])
    assert time.time() - start < 120
