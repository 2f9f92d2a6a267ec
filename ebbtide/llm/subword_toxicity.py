"""Toxicity by bags of subwords: character n-gram embeddings, averaged, into a linear softmax, trained jointly in numpy.

Words are lower-cased and cut into n-grams of three to five bytes with their word boundary, hashed into a table of
embeddings, so a misspelt word shares most vectors with the word it comes from. A text is read in windows of a few words
(all of them, whatever its length); the n-gram vectors of its different words are averaged (a short or repetitive window is
filled up with zeros) and go into the softmax, and the most toxic window gives the score, so that a long clean text does
not hide a toxic sentence. In training each document teaches with its most toxic window, after some rounds over the
average of all of it.

Scoring needs only the embedding table times the difference of the two softmax rows: one number per n-gram. It is the
only thing that is broadcast, and documents are not shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.bm25_index import plain
from ebbtide.llm.grams import gram_index, inside_rows, packed
from ebbtide.llm.quality_neighbours import score_texts
from ebbtide.llm.tables import held_out, sample_by_label, table
from ebbtide.llm.text import mix, words

ORDERS, BITS, DIMENSIONS, WORDS, LEAST = (3, 4, 5), 18, 8, 16, 120
SAMPLE, LONGEST, EPOCHS, WHOLE_EPOCHS, RATE, GAIN = 1200, 1 << 15, 12, 4, 0.4, 12.0


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of the different words of each window: n-gram, window, and the n+1 first windows of the rows.

    A row has one window at least.
    """
    letters = plain(data)
    hashes, starts, _, at = words(letters, offsets)
    n_words = np.diff(at)
    base = np.concatenate([[0], np.cumsum(np.maximum(1, -(-n_words // WORDS)))])
    row = np.repeat(np.arange(len(n_words)), n_words)
    window = base[row] + (np.arange(len(row)) - at[row]) // WORDS
    new = np.zeros(len(row), bool)
    new[np.unique(hashes + mix(window.astype(np.uint64)), return_index=True)[1]] = True
    word = np.repeat(np.arange(-1, len(starts)), np.diff(np.concatenate([[0], starts, [len(letters)]])))
    spaces = np.concatenate([[0], np.cumsum(letters == 32, dtype=np.int32)])
    found, where = [], []
    for order in ORDERS:
        index = gram_index(letters, order, BITS)
        n = len(index)
        inner = spaces[order - 1 : order - 1 + n] - spaces[1 : n + 1] if n else spaces[:0]
        good = np.flatnonzero(inside_rows(offsets, order, n) & (inner == 0))
        owner = word[good + 1]
        keep = new[owner] if len(new) else np.zeros(0, bool)
        found.append(index[good[keep]])
        where.append(window[owner[keep]])
    return np.concatenate(found), np.concatenate(where), base


class SubwordSoftmax:
    def __init__(self, texts: list[str], labels: list[int], prior: float = 0.5, seed: int = 5):
        """Classes weigh the same in training; `prior`, the share of toxic rows, then moves the bias."""
        rng = np.random.default_rng(seed)
        table_ = rng.uniform(-0.1, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
        softmax = np.zeros((2, DIMENSIONS), np.float32)
        softmax[1] = rng.uniform(0.1, 0.3, DIMENSIONS)
        bias, squares = np.array([0.5, -0.5]), np.full(1 << BITS, 1e-4, np.float32)
        bags = []
        for text in texts:
            grams, window, base = subwords(*packed([text]))
            order = np.argsort(window, kind="stable")
            bags.append((grams[order].astype(np.int32), np.bincount(window, minlength=base[-1])))
        share = np.mean(labels) if len(labels) else 0.5
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 0.02
            for r in rng.permutation(len(bags)):
                grams, sizes = bags[r]
                if not len(grams):
                    continue
                if epoch >= WHOLE_EPOCHS and len(sizes) > 1:
                    edge = np.concatenate([[0], np.cumsum(sizes)])
                    run = np.concatenate([[0.0], np.cumsum(table_[grams] @ (softmax[1] - softmax[0]), dtype=float)])
                    top = int(np.argmax((run[edge[1:]] - run[edge[:-1]]) / np.maximum(sizes, LEAST)))
                    grams = grams[edge[top] : edge[top + 1]]
                n = max(LEAST, len(grams))
                mean = table_[grams].sum(0) / n
                logit = GAIN * (softmax @ mean) + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                error = p.copy()
                error[labels[r]] -= 1
                error *= 0.5 / (share if labels[r] else 1 - share)
                if abs(error[0]) < 1e-3:
                    continue
                back = GAIN * (error @ softmax).astype(np.float32)
                softmax -= (rate * 0.05 * GAIN * np.outer(error, mean)).astype(np.float32)
                bias -= rate * 0.05 * error
                each, times = np.unique(grams, return_counts=True)
                step = np.outer(times / n, back).astype(np.float32)
                squares[each] += (step**2).mean(1)
                table_[each] -= rate * step / np.sqrt(squares[each])[:, None]
        self.weights = (GAIN * (table_ @ (softmax[1] - softmax[0]))).astype(np.float32)
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        self.bias = float(bias[1] - bias[0] + np.log(prior / (1 - prior)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        grams, window, base = subwords(data, offsets)
        total = np.bincount(window, self.weights[grams], base[-1])
        mean = total / np.maximum(np.bincount(window, minlength=base[-1]), LEAST)
        return 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(mean, base[:-1]) + self.bias, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> SubwordSoftmax | None:
    """A model from about `sample` rows of each label with at most LONGEST bytes, none of them held out."""
    told = labels.where(F.col(label).isin(0, 1) & ~held_out(5, 0, key)).select(key, label).distinct()
    narrow = told.select(F.col(key).alias("doc_id"), F.col(label).alias("label"))
    picked = sample_by_label(narrow, "label", sample)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") <= LONGEST)
    chosen = sorted(rows.join(F.broadcast(picked), "doc_id").collect(), key=lambda r: (r["doc_id"], r["label"], r["text"]))
    prior = narrow.agg(F.avg("label")).first()[0]
    return SubwordSoftmax([r["text"] for r in chosen], [r["label"] for r in chosen], prior) if chosen else None


def op6_toxicity(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score_texts(docs, learn(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
