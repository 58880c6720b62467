"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Byte bigrams and trigrams of a text are hashed into ``BINS`` counts, with two terms for repetition beside them, weighted by tf-idf and projected on the leading singular vectors of a
bounded labelled sample (latent semantic analysis). The sample's unit vectors, a fixed ``2 * PER_CLASS`` of ``RANK`` numbers whatever the
corpus, are broadcast; every document is compared with all of them by blocked matrix products, and its ``NEIGHBOURS`` nearest vote with
their cosines as weights. One narrow pass over the documents, no shuffle.

Null and empty texts have no features and score the share of label 1 in the sample's source, ``prior``. Repeated label rows count once
(the lower label); labels other than 0 and 1 are ignored; of rows with one labelled id the one with the least text hash is learnt from. Ties between neighbours fall either way. Without any label every document scores 0.5. An empty table gives no rows. Extra
columns pass through ``score``. A text of any length is read whole, in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import held_out, least_hashed, prepare, text_of
from marlstone.llm.words import Words, rolled

BINS, RANK, PER_CLASS, NEIGHBOURS = 2048, 64, 1500, 15
#: Occurrences that one repetition counts as.
REPEAT_WEIGHT = 100
#: Bytes of a text counted at once.
BLOCK = 1 << 20
#: Votes weigh as this power of the cosine.
SHARPNESS = 4


def features(column: pa.Array, names: Words | None = None, bins: int = BINS) -> np.ndarray:
    """For each text, log counts of hashed byte bigrams and trigrams, half of the bins for each. Bin 0 of each half is for repetition: words that follow
    themselves, runs of five words that the text has had before."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    v, bounds = (names or Words(fold=False)).read(texts)
    out = np.zeros((len(texts), bins), np.float32)
    half = bins // 2
    shift = np.uint32(32 - (half.bit_length() - 1))
    for row, raw, first, last in zip(out, texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        b = np.frombuffer(raw.as_buffer(), np.uint8)
        for i in range(0, len(b) - 1, BLOCK):  # in blocks that overlap by two bytes
            two = b[i : i + BLOCK + 1].astype(np.uint32)
            two = two[:-1] << np.uint32(8) | two[1:]
            row[1:half] += np.bincount((two * np.uint32(2654435761)) >> shift, minlength=half)[1:]
            three = two[: max(len(b) - 2 - i, 0)]
            three = three << np.uint32(8) | b[i + 2 : i + 2 + len(three)]
            row[half + 1 :] += np.bincount((three * np.uint32(2246822519)) >> shift, minlength=half)[1:]
        words = v[first:last]
        row[0] = REPEAT_WEIGHT * int((words[1:] == words[:-1]).sum())
        runs = np.sort(rolled(words, 5)) if len(words) > 5 else words[:0]
        row[half] = REPEAT_WEIGHT * int((runs[1:] == runs[:-1]).sum())
    return np.log1p(out)


@dataclass(frozen=True)
class Voter:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array, names: Words | None = None) -> np.ndarray:
        counts = features(texts, names)
        out = np.full(len(texts), self.prior)
        full = np.flatnonzero(counts.any(axis=1))
        if len(full) and len(self.labels):
            cosines = self.embed(counts[full]) @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosines, near, 1), 0, 1).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            votes = (weight * self.labels[near]).sum(axis=1)
            out[full] = np.where(total > 0, votes / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit_voter(counts: np.ndarray, labels: np.ndarray, prior: float, rank: int = RANK) -> Voter:
    n = len(labels)
    if not n:
        none = np.zeros((0, min(rank, BINS)), np.float32)
        return Voter(np.ones(BINS, np.float32), np.zeros((BINS, none.shape[1]), np.float32), none, np.zeros(0), 0.5)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = counts * idf
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh(x.T @ x)  # in single precision: a task holds a few matrices of BINS x BINS
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :rank])
    del vectors
    v = x @ axes
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return Voter(idf, axes, v.astype(np.float32), labels.astype(np.float64), prior)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 3) -> Voter:
    """Learn from at most ``per_class`` documents of each label, those with the smallest hash of their id, none of them held out."""
    prepare(docs.sparkSession)
    known = (
        labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(folds))
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
    )
    share = known.agg(F.avg("label").alias("prior")).first().prior
    texts = docs.select("doc_id", "text")
    # at most per_class ids of each label
    wanted = [least_hashed(known.where(F.col("label") == v), per_class, "doc_id") for v in (0, 1)]
    sample = texts.join(F.broadcast(wanted[0].unionByName(wanted[1])), "doc_id")
    # one text for each id, however many rows have it: chosen and counted on the executors
    sample = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Words(fold=False)
        for b in batches:
            rows = [x.tobytes() for x in features(b.column("text"), names).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "counts"])

    share = 0.5 if share is None else float(share)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("counts", pa.binary())]))
        t = t.sort_by([("label", "ascending"), ("doc_id", "ascending")])
        counts = np.empty((len(t), BINS), np.float32)
        for row, c in zip(counts, t.column("counts"), strict=True):
            row[:] = np.frombuffer(c.as_buffer(), np.float16)
        made = pickle.dumps(fit_voter(counts, t.column("label").to_numpy(), share))
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["voter"])

    # the sample, of fixed size, meets in one task: the driver gets only what the executors are sent
    rows = sample.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(counted, "doc_id long, label int, counts binary")
    made = rows.repartition(1).mapInArrow(fitted, "voter binary").collect()
    return pickle.loads(made[0].voter) if made else fit_voter(np.zeros((0, BINS), np.float32), np.zeros(0), share)


def score(docs: DataFrame, voter: Voter) -> DataFrame:
    """``docs`` with ``quality_score``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Words(fold=False)
        for b in batches:
            got = shared.value.score(b.column("text"), names)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], schema=b.schema.append(pa.field("quality_score", pa.float64())))

    return docs.drop("quality_score").mapInArrow(scored, docs.drop("quality_score").schema.add("quality_score", "double"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_of().alias("text"))
    voter = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, voter)
    return out.select("doc_id", held_out(3).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
