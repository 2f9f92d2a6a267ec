"""Quality scores by a vote of nearest neighbours among labelled documents in a latent semantic space.

The space: square roots of byte trigram counts (case and punctuation kept), weighted by inverse document frequency and
projected on the leading singular vectors, all fitted on a bounded sample (a parameter) of labelled rows. The labelled
vectors are broadcast: at most 2 x SAMPLE x DIMENSIONS numbers. Every document is projected and its cosine with every
labelled vector is computed exactly, a block of documents at a time; the nearest ones vote, weighted by similarity.
Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.grams import gram_index, inside_rows, owners, packed
from ebbtide.llm.tables import held_out, sample_by_label, ship, table
from ebbtide.llm.text import slices

BITS, ORDER, DIMENSIONS, NEIGHBOURS, SHARPNESS, BLOCK = 12, 3, 64, 25, 8, 256
SAMPLE, LONGEST = 2000, 1 << 16


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x 2**BITS: square roots of trigram counts."""
    index = gram_index(data, ORDER, BITS)
    good = inside_rows(offsets, ORDER, len(index))
    key = (owners(offsets)[: len(index)] << BITS) + index
    n = len(offsets) - 1
    return np.sqrt(np.bincount(key[good], minlength=n << BITS).reshape(n, -1)).astype(np.float32)


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK):
    for a in range(0, len(offsets) - 1, size):
        part = offsets[a : a + size + 1]
        yield counts(data[part[0] : part[-1]], part - part[0])


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_vectors(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :k]


class NeighbourVote:
    def __init__(self, texts: list[str], labels: list[int], weight_of: dict[int, float]):
        data, offsets = packed(texts)
        x = np.concatenate(list(blocks(data, offsets)))
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
        x = unit_rows(x * self.idf)
        self.basis = leading_vectors(x, DIMENSIONS)
        self.vectors = unit_rows(x @ self.basis)
        self.labels = np.array(labels, np.float32)
        self.weight = np.array([weight_of[y] for y in labels], np.float32)
        self.prior = float((self.labels * self.weight).sum() / self.weight.sum())

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out, k = [], min(NEIGHBOURS, len(self.labels))
        for x in blocks(data, offsets):
            cosine = unit_rows((x * self.idf) @ self.basis) @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            power = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS * self.weight[near]
            out.append(((power * self.labels[near]).sum(1) + 0.05 * self.prior) / (power.sum(1) + 0.05))
        return np.concatenate(out).astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE):
    """The labelled vectors of about `sample` rows of each label with at most LONGEST bytes, none of them held out."""
    told = labels.where(F.col(label).isin(0, 1) & ~held_out(5, 0, key)).select(key, label).distinct()
    narrow = told.select(F.col(key).alias("doc_id"), F.col(label).alias("label"))
    picked = sample_by_label(narrow, "label", sample)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") <= LONGEST)
    chosen = sorted(rows.join(F.broadcast(picked), "doc_id").collect(), key=lambda r: (r["doc_id"], r["label"], r["text"]))
    if not chosen:
        return None
    total = {r["label"]: r["count"] for r in narrow.groupBy("label").count().collect()}
    mean = {y: total[y] / max(1, sum(r["label"] == y for r in chosen)) for y in total}
    largest = max(mean.values())
    return NeighbourVote([r["text"] for r in chosen], [r["label"] for r in chosen],
                         {y: m / largest for y, m in mean.items()})


def score_texts(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `score` of each row by model.score; NULL counts as empty; 0.5 for all if nothing was learned."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1), 1 << 20):
                score = np.full(last - first, 0.5) if shared.value is None else shared.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(np.clip(score, 0.0, 1.0))], names=["key", "score"])

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op3_quality(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score_texts(docs, learn(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
