import math
import random
import textwrap

import pytest

from marlstone.llm import license_scan as L

PLAIN = ["the river runs to the sea", "this is the version of the story", "under the bridge it is dark", "people use the public road"] * 5


@pytest.fixture(scope="module")
def model():
    return L.train([p.split() for p in PLAIN])


def test_families_and_unknown(documents, model):
    rows = [
        (1, "some words\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0"), (3, "text\n\nLicensed under CC BY-NC 4.0."), (4, "This work is licensed under the GNU General Public License, version 2."),
        (5, "Licensed under the Foo Bar Baz License 7"), (6, "the general public was under the bridge"), (7, None), (8, ""),
    ]
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in L.scan(documents(rows), model).collect()}
    assert got == {(1, 1): ("MIT", True), (2, 0): ("Apache-2.0", True), (3, 2): ("CC-BY-NC", True), (4, 0): ("GPL", True), (5, 0): ("unknown", False)}


def test_anchors_lose_nothing(documents, model):
    from dataclasses import replace

    texts = ["Permission is hereby granted, free of charge, to any person", "see the notice below", "public domain", "gnu", "a license to drive", "version 2 or later", "the terms apply to people"]
    docs = documents(list(enumerate(texts)))
    key = lambda rows: sorted((r.doc_id, r.family, round(r.probability, 9)) for r in rows)
    assert key(L.scan(docs, model).collect()) == key(L.scan(docs, replace(model, anchors=[])).collect())


def plain_scan(text, model):
    """The rows of a text, paragraph by paragraph with plain Python."""
    lines = []
    for line in (text or "").split("\n"):
        if lines and 30 <= len(lines[-1][1]) <= 120 and line[:1].strip():
            lines[-1] = (lines[-1][0] + " " + line, line)
        else:
            lines.append((line, line))
    out = []
    families = {f: [set(L.tokens_of(t)) for t in ts] for f, ts in L.TEMPLATES.items()}
    weigh = lambda w: math.log(1 + len(families) / sum(any(w in t for t in ts) for ts in families.values()))
    for i, (paragraph, _) in enumerate(lines):
        w = L.tokens_of(paragraph)
        grams = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}  # noqa: B905
        z = [(b + sum(model.weights[g][c] for g in grams if g in model.weights)) / model.temperature for c, b in enumerate(model.bias)]
        p = [math.exp(v - max(z)) for v in z]
        p = [v / sum(p) for v in p]
        if 1 - p[-1] < 0.5:
            continue
        best = max(p[:-2])
        family, probability = (model.classes[p.index(best)], best) if best >= L.SURE else ("unknown", 1 - p[-1])
        similarity = max((sum(weigh(x) for x in t if x in w) / sum(map(weigh, t)) for t in families.get(family, ())), default=0.0)
        out.append((i, family if similarity >= L.COVERED else "unknown", round(probability, 9), round(similarity, 9), similarity >= L.COVERED))
    return out


def test_scan_against_a_plain_scorer(documents, model):
    pick = random.Random(1)
    notices = [t for ts in L.TEMPLATES.values() for t in ts] + [*L.UNKNOWN, *L.PLAIN]
    texts = []
    for _ in range(120):
        parts = [pick.choice([*PLAIN, *notices, "", "short"]) for _ in range(6)]
        parts = [" ".join(w for w in p.split(" ") if pick.random() > 0.1) for p in parts]
        texts.append(pick.choice(["\n", "\n\n", " "]).join(parts))
    got = {}
    for r in L.scan(documents(list(enumerate(texts))), model).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, round(r.probability, 9), round(r.similarity, 9), r.confirmed))
    assert {d: sorted(rows) for d, rows in got.items()} == {d: rows for d, t in enumerate(texts) if (rows := plain_scan(t, model))}


#: Opening sentences of three public licence texts.
NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
}


@pytest.mark.parametrize("width", [60, 72, 80])
def test_hard_wrapped_notices_are_one_paragraph(documents, model, width):
    rows = [(i, f"{PLAIN[0]}\n\n{textwrap.fill(t, width)}\n\n{PLAIN[1]}") for i, t in enumerate(NOTICES.values())]
    got = sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in L.scan(documents(rows), model).collect())
    assert got == [(i, 2, f, True) for i, f in enumerate(NOTICES)]


def test_calibration_on_notices_left_out(model):
    assert model.calibration_error < 0.12 and model.unseen_accuracy > 0.4


def test_plain_paragraphs_with_licence_words(documents, model):
    rows = [(1, "the man had lost the license of his dog"), (2, "permission to enter the house was granted by the king"), (3, "they spoke of copyright and of the river")]
    assert not [r for r in L.scan(documents(rows), model).collect() if r.family != "unknown"]


def test_sample_reads_whole_texts(documents):
    """Paragraphs from all over the texts are learnt from."""
    rows = [(i, "\n".join(f"line{j} of many words in a text" for j in range(40))) for i in range(50)]
    assert any(g.startswith("line39") or g.startswith("line2") for g in L.fit(documents(rows)).weights) or L.fit(documents(rows), paragraphs=2000).anchors


def test_very_long_texts(documents, model):
    rows = [(1, "word " * 4_000_000 + "\nReleased under the MIT License."), (2, "x" * 1_000_000), (3, "some line of some forty or more characters here\n" * 400_000)]
    assert [(r.doc_id, r.family) for r in L.scan(documents(rows), model).collect()] == [(1, "MIT")]


def test_awkward_rows(documents, awkward, model):
    assert L.scan(documents(awkward), model).count() == 0
    assert L.scan(documents([(1, "Released under the MIT License.")] * 3), model).count() == 1
    assert L.scan(documents([]), L.fit(documents([]))).count() == 0


def test_no_python_in_the_plan(documents, model):
    plan = L.scan(documents([(1, "x")]), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
