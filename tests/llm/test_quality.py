import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import quality

GOOD, BAD = "the quiet river of the north was seen by many people in the town {} ", "BUY!! NOW!! CHEAP!! PILLS!! $$$ *** {} "


@pytest.fixture
def labelled(spark, documents):
    rows = [(i, (GOOD if i % 3 else BAD).format(i) * (1 + i % 4)) for i in range(300)]
    return documents(rows), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and all((r.quality_score >= 0.5) == (r.doc_id % 3 > 0) for r in held)
    assert all(r.score == "x" for r in rows)


def test_the_driver_fits_nothing(labelled, monkeypatch):
    """Its memory is the scarcest: the sample's features and the matrices of the fit stay on the executors, whose workers are other processes."""

    def refused(*_, **__):
        raise AssertionError("in the driver")

    monkeypatch.setattr(np.linalg, "eigh", refused)
    monkeypatch.setattr("pyspark.sql.DataFrame.toPandas", refused)
    voter = quality.fit(*labelled)
    assert len(voter.labels) == len(voter.vectors) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300))


def test_held_out_labels_are_not_learnt(labelled):
    docs, labels = labelled
    from marlstone.llm.common import held_out
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(held_out(3), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.labels, b.labels) and np.allclose(a.vectors, b.vectors) and a.prior == b.prior


def plain_features(text):
    """Counted one by one."""
    b, half = text.encode(), quality.BINS // 2
    out = [0.0] * quality.BINS
    for width, factor, base in ((2, 2654435761, 0), (3, 2246822519, half)):
        for i in range(len(b) - width + 1):
            at = (int.from_bytes(b[i : i + width], "big") * factor & 0xFFFFFFFF) >> 22
            out[base + at] += at > 0
    w = text.split()
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) > 5 else []
    out[0] = 100 * sum(a == b for a, b in zip(w, w[1:]))  # noqa: B905
    out[half] = 100 * (len(runs) - len(set(runs)))
    return np.log1p(np.array(out))


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_features_against_counting_one_by_one(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    texts = ["", None, "a", "ab", "abc", "é漢😀 x", "no no no yes", GOOD * 3, BAD, "one two three four five six one two three four five six"]
    got = quality.features(pa.array(texts))
    assert np.allclose(got, np.stack([plain_features(t or "") for t in texts]), atol=1e-5)


def test_scores_against_a_plain_version(spark, documents):
    """Tf-idf, singular vectors, cosines with all sample vectors and the weighted vote, each written out with other means."""
    pick = np.random.default_rng(3)
    word = lambda: "".join(pick.choice(list("abcdefgh"), 4))
    rows = [(i, " ".join(word() for _ in range(20)) + (" zz!" * int(pick.integers(1, 9)) if i % 2 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    voter = quality.fit(documents(rows), labels)
    learnt = sorted((i % 2, i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    counts = np.stack([plain_features(t) for _, _, t in learnt]).astype(np.float16).astype(float)
    idf = np.log((1 + len(learnt)) / (1 + (counts > 0).sum(axis=0))) + 1
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(counts * idf)
    axes = np.linalg.svd(x, full_matrices=False)[2][: quality.RANK].T
    sample = unit(x @ axes)
    texts = [t for _, t in rows[:40]]
    got = voter.score(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        cosines = sample @ unit(unit(plain_features(text)[None] * idf) @ axes)[0]
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weights = np.clip(cosines[near], 0, 1) ** quality.SHARPNESS
        assert score == pytest.approx(float((weights * [learnt[i][0] for i in near]).sum() / weights.sum()), abs=1e-3)


def test_an_id_on_many_rows_is_learnt_once(spark, documents):
    rows = [(0, f"{GOOD} {i}") for i in range(10_000)] + [(i, BAD * i) for i in range(1, 30)]
    labels = spark.createDataFrame([(i, int(i == 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    voter = quality.fit(documents(rows), labels)
    assert len(voter.labels) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(30))


def test_very_long_texts(labelled, documents):
    docs, labels = labelled
    got = {r.doc_id: r.quality_score for r in quality.score(documents([(1, GOOD * 300_000), (2, "x" * 20_000_000), (3, "word " * 4_000_000)]), quality.fit(docs, labels)).collect()}
    assert set(got) == {1, 2, 3} and all(0 <= x <= 1 for x in got.values())


def test_awkward_rows(spark, documents, awkward, labelled):
    _, labels = labelled
    docs = documents(awkward)
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == len(awkward) and all(0 <= r.quality_score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.quality_score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 0), (2, None, 0), (3, 7, 0)], labels.schema)
    quality.score(docs, quality.fit(docs, odd)).collect()
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
