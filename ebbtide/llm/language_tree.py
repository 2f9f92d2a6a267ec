"""Language identification in two steps: linear support vector machines tell the family, then one-versus-one machines
between the languages of that family tell the language.

Features are relative frequencies of hashed byte bigrams and trigrams of the whole text, in lower case and without
punctuation. Machines are trained in numpy on a bounded sample (a parameter) of labelled rows. Each is one weight per
feature, so a task adds up weights along its texts; documents are not shuffled and only the weights are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.bm25_index import plain
from ebbtide.llm.grams import gram_index, inside_rows, packed
from ebbtide.llm.tables import held_out, sample_by_label, ship, table
from ebbtide.llm.text import slices

#: Families of languages; a language that is not named is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is",
    "romance": "fr es it pt ro ca",
    "slavic": "ru uk pl cs sk bg sr hr sl",
}
ORDERS, BITS, SCALE = (2, 3), 16, 30.0
SAMPLE, LONGEST, EPOCHS, DECAY = 800, 1 << 16, 12, 1e-4
#: Below this probability the pipeline takes a text for none of the learned languages.
LEAST = 0.3


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members.split()), language)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the feature at each place, and whether it counts."""
    letters = plain(data)
    out = []
    for k, order in enumerate(ORDERS):
        index = gram_index(letters, order, BITS) + (k << BITS)
        out.append((index, inside_rows(offsets, order, len(index))))
    return out


def sums(index: list[tuple[np.ndarray, np.ndarray]], offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the features of each row."""
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for place, good in index:
        run = np.concatenate([[0.0], np.cumsum(np.where(good, weights[place], 0.0), dtype=np.float64)])
        hits = np.concatenate([[0], np.cumsum(good)])
        a, b = np.minimum(offsets[:-1], len(place)), np.minimum(offsets[1:], len(place))
        total += run[b] - run[a]
        count += hits[b] - hits[a]
    return SCALE * total / np.maximum(count, 1)


def train_machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, seed: int = 7):
    """Weights, bias and slope (of the logistic curve over margins) of one machine: hinge loss, averaged steps."""
    rng = np.random.default_rng(seed)
    w, mean = np.zeros(len(ORDERS) << BITS), np.zeros(len(ORDERS) << BITS)
    scale, bias, mean_bias, step, kept = 1.0, 0.0, 0.0, 0, 0
    for epoch in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            step += 1
            rate = 1 / (DECAY * (step + 1000))
            index, value = rows[r]
            margin = sign[r] * (scale * (w[index] @ value) + bias)
            scale *= 1 - rate * DECAY
            if margin < 1:
                w[index] += rate * sign[r] * value / scale
                bias += rate * DECAY * sign[r]
        if epoch >= EPOCHS // 2:
            mean, mean_bias, kept = mean + scale * w, mean_bias + bias, kept + 1
    w, bias = mean / kept, mean_bias / kept
    margins = sign * np.array([w[i] @ v + bias for i, v in rows])
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins, -30, 30)))
        grad = ((1 - p - 0.02) * margins).mean()
        slope = float(np.clip(slope + 2 * grad, 0.1, 10))
    return w.astype(np.float32), float(bias), slope


def vote(margins: dict[tuple[str, str], np.ndarray], names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner (place in names) and its lowest probability against another name, by duels; ties by summed margins."""
    wins, lowest, total = (np.full((n, len(names)), x) for x in (0.0, 1.0, 0.0))
    for (a, b), p in margins.items():
        i, j = names.index(a), names.index(b)
        wins[:, i] += p >= 0.5
        wins[:, j] += p < 0.5
        lowest[:, i], lowest[:, j] = np.minimum(lowest[:, i], p), np.minimum(lowest[:, j], 1 - p)
        total[:, i] += p
        total[:, j] += 1 - p
    best = np.argmax(wins + 1e-3 * total / max(1, len(names)), 1)
    return best, lowest[np.arange(n), best]


class LanguageTree:
    def __init__(self, texts: list[str], languages: list[str]):
        self.families: dict[str, list[str]] = {}
        for name in sorted(set(languages)):
            self.families.setdefault(family_of(name), []).append(name)
        rows = []
        for text in texts:
            data, offsets = packed([text])
            index, count = np.unique(np.concatenate([i[g] for i, g in features(data, offsets)]), return_counts=True)
            rows.append((index, SCALE * count / max(1, count.sum())))
        language = np.array(languages)
        family = np.array([family_of(x) for x in languages])
        self.duels = [self.duel(rows, family, a, b) for a, b in combinations(sorted(self.families), 2)]
        self.inner = {f: [self.duel(rows, language, a, b) for a, b in combinations(members, 2)]
                      for f, members in self.families.items()}

    @staticmethod
    def duel(rows, label, a, b):
        use = np.flatnonzero((label == a) | (label == b))
        return (a, b), *train_machine([rows[k] for k in use], np.where(label[use] == a, 1.0, -1.0))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        index, n = features(data, offsets), len(offsets) - 1

        def odds(machines):
            return {pair: 1 / (1 + np.exp(-np.clip(slope * (sums(index, offsets, w) + bias), -30, 30)))
                    for pair, w, bias, slope in machines}

        names = sorted(self.families)
        best, sure = vote(odds(self.duels), names, n)
        found, score = [""] * n, sure.copy()
        for f, members in self.families.items():
            inner, inner_sure = vote(odds(self.inner[f]), members, n)
            for r in np.flatnonzero(best == names.index(f)):
                found[r], score[r] = members[inner[r]], sure[r] * inner_sure[r]
        return found, score


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE):
    """The machines, from about `sample` rows of each language with at most LONGEST bytes, none of them held out."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    free = rows.where(~held_out(4, 2) & (F.octet_length("text") <= LONGEST) & F.col("text").rlike(r"\p{L}"))
    narrow = rows.where(~held_out(4, 2)).select("doc_id", "lang")
    chosen = sample_by_label(narrow, "lang", sample, rows=free).select("doc_id", "text", "lang").collect()
    chosen = sorted(chosen, key=lambda r: (r["doc_id"], r["text"]))
    return LanguageTree([r["text"] for r in chosen], [r["lang"] for r in chosen]) if chosen else None


def identify(docs: DataFrame, model: LanguageTree | None, text: str = "text") -> DataFrame:
    """Adds `lang_pred` and `score` to every row. `und` with score 0: NULL, no letter, or nothing was learned."""
    ship(docs.sparkSession)
    columns = docs.columns
    rest = [f"c{k}" for k in range(len(columns))]
    plain_docs = docs.toDF(*rest)
    tried = plain_docs.withColumn("lettered", F.coalesce(F.col(rest[columns.index(text)]).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(place), 1 << 19):
                part = batch.slice(first, last - first)
                found, score = [None] * (last - first), np.zeros(last - first)
                if shared.value is not None:
                    found, score = shared.value.predict(data, offsets)
                has = part.column(len(rest)).to_numpy(zero_copy_only=False) & (shared.value is not None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([f if h else "und" for f, h in zip(found, has)]),
                     pa.array(np.where(has, score, 0.0))], names=[*rest, "lang_pred", "score"])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(rest, docs.schema))
    return tried.mapInArrow(predict, f"{schema}, lang_pred string, score double").toDF(*columns, "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageTree | None, least: float = LEAST, text: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, whose language is told: not `und`, and not less sure than `least`."""
    columns = [f"c{k}" for k in range(len(docs.columns))]
    found = identify(docs.toDF(*columns), model, columns[docs.columns.index(text)])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*columns).toDF(*docs.columns)


def op8_language(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
