"""Benchmark decontamination: passages of every document are queries to a BM25 index of the test items.

The items are the indexed documents: a term's weight in an item is its BM25 impact, divided by the sum of the item's
impacts, so that a passage which holds a whole item scores 1 for it. Postings are kept in blocks of a few items with the
largest weight of the block. As in block-max WAND, a passage first adds up block maxima; only blocks whose bound reaches
the threshold are opened, and there every item is scored exactly. All items at or above the threshold are retrieved, no
top-k. A retrieved item counts as leaked if the passage also holds enough of its question and of its answer in order
(shares of their word trigrams).

Passages overlap by half and are twice as long as the longest item, so no occurrence of an item is cut. Documents are
not shuffled. The index goes to the tasks in parts of a bounded size, one part after the other; only hits are kept. What
a score depends on (number and lengths of items, items with a term) is counted over all items before they are parted, so
scores do not depend on the parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ebbtide.llm.tables import ship, table
from ebbtide.llm.text import raw_texts, runs, slices, words
from ebbtide.session import materialise

THRESHOLD, QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.6, 0.6
K1, B, BLOCK_ITEMS, PART_BYTES = 1.2, 0.75, 8, 4 << 20
#: Block entries that are added up at once, unless one passage has more.
ENTRIES = 1 << 18
SENTENCE_ENDS = np.frombuffer(b".!?\n", np.uint8)


def letters_table() -> np.ndarray:
    """ASCII letters in lower case, digits and bytes of other scripts unchanged, the rest a space."""
    out = np.full(256, 32, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            out[b] = ord(chr(b).lower()) if b < 128 else b
    return out


LETTERS = letters_table()


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes without case (ASCII and Latin-1 letters) and punctuation, in the same places."""
    out = LETTERS[data]
    if len(out):
        upper = np.zeros(len(out), bool)
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        out[upper] += 0x20
    return out


@dataclass(frozen=True)
class Statistics:
    """What BM25 counts over all items: their number, mean and largest number of words, and, sorted by term, the number
    of items that hold it."""

    items: int
    mean_words: float
    most_words: int
    terms: np.ndarray
    frequency: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Statistics:
        owner, hashes, n = terms_of(pa.array(texts, pa.large_string()))
        terms, frequency = np.unique(hashes, return_counts=True)
        return Statistics(len(n), float(n.mean()) if len(n) else 0.0, int(n.max(initial=0)), terms, frequency)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct term of each text, and the number of words of each text."""
    data, offsets = raw_texts(column)
    hashes, _, _, at = words(plain(data), offsets)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[first], hashes[first], n


class Index:
    """Inverted index with block maxima over item texts, weighted by the statistics of all items (by default these)."""

    def __init__(self, items: list[tuple[object, str]], of_all: Statistics | None = None):
        items = sorted(items, key=lambda x: (len(x[1] or ""), x[1] or ""))  # similar lengths share a block
        of_all = of_all or Statistics.of([t for _, t in items])
        self.ids = [i for i, _ in items]
        data, offsets = raw_texts(pa.array([t or "" for _, t in items], pa.large_string()))
        hashes, starts, _, at = words(plain(data), offsets)
        self.at, self.hashes, n = at, hashes, np.diff(at)
        self.longest = max(1, of_all.most_words)
        owner = np.repeat(np.arange(len(items)), n)
        self.terms, term = np.unique(hashes, return_inverse=True)
        key, tf = np.unique(term * max(1, len(items)) + owner, return_counts=True)
        term, item = key // max(1, len(items)), key % max(1, len(items))
        df = of_all.frequency[np.searchsorted(of_all.terms, self.terms)]
        idf = np.log1p((of_all.items - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / max(1.0, of_all.mean_words)))
        total = np.bincount(item, weight, len(items))
        self.item, self.weight = item, weight / total[item]  # by term, then item
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.weight, self.first[:-1]) if len(term) else np.zeros(0)
        block_key, start = np.unique(term * (len(items) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS, return_index=True)
        self.n_blocks = len(items) // BLOCK_ITEMS + 1
        self.block, self.block_max = block_key % self.n_blocks, np.maximum.reduceat(self.weight, start) if len(
            start) else np.zeros(0)
        self.block_posting = np.append(start, len(self.item))
        self.block_first = np.searchsorted(block_key // self.n_blocks, np.arange(len(self.terms) + 1))
        self.grams = [self.parts(k, data[offsets[k] : offsets[k + 1]], starts - offsets[k]) for k in range(len(items))]

    def parts(self, k: int, raw: np.ndarray, starts: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Word trigrams (or shorter, with their length) of an item's question and answer; the answer is the last
        sentence, or the last third of an item that is one sentence."""
        h, s = self.hashes[self.at[k] : self.at[k + 1]], starts[self.at[k] : self.at[k + 1]]
        ends = np.flatnonzero(np.isin(raw, SENTENCE_ENDS))
        cut = np.searchsorted(s, ends[ends < (s[-1] if len(s) else 0)].max(initial=0))
        if not 0 < cut < len(h):
            cut = len(h) - max(1, len(h) // 3)
        return [(n, np.unique(runs(x, n))) for x in (h[:cut], h[cut:]) for n in [min(3, len(x))]]


def spread(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its places first[key] ... first[key + 1] - 1, and which key a place is of."""
    n = first[keys + 1] - first[keys]
    rep = np.repeat(np.arange(len(keys)), n)
    return first[keys][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n), rep


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float):
    """(passage, item, score) of all scores at or above the threshold; (passage, term) pairs are distinct, by passage.

    Passages are taken in groups of about `ENTRIES` block entries, so the arrays do not grow with passages x blocks.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(term):
        bound = np.bincount(passage, index.term_max[term])
        live = bound[passage] >= threshold - 1e-9
        passage, term = passage[live], term[live]
    upto = np.cumsum(np.diff(index.block_first)[term]) if len(term) else np.zeros(0, np.int64)
    last_of = np.flatnonzero(np.append(passage[1:] != passage[:-1], True)) if len(term) else np.zeros(0, np.int64)
    first = 0
    while first < len(term):
        before = upto[first - 1] if first else 0
        ends = last_of[np.searchsorted(last_of, first) :]
        end = ends[max(0, np.searchsorted(upto[ends], before + ENTRIES, "right") - 1)] + 1
        found.append(open_blocks(index, passage[first:end], term[first:end], threshold))
        first = end
    return tuple(np.concatenate(x) for x in zip(*found))


def open_blocks(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float):
    """Scores of the items in those blocks whose summed maxima reach the threshold."""
    place, rep = spread(index.block_first, term)
    _, inverse = np.unique(passage[rep] * index.n_blocks + index.block[place], return_inverse=True)
    live = np.bincount(inverse, index.block_max[place])[inverse] >= threshold - 1e-9
    place, rep = place[live], rep[live]
    posting, rep2 = spread(np.stack([index.block_posting[:-1], index.block_posting[1:]], 1).ravel(), 2 * place)
    n_items = len(index.ids)
    key, inverse = np.unique(passage[rep[rep2]] * n_items + index.item[posting], return_inverse=True)
    score = np.bincount(inverse, index.weight[posting], len(key))
    good = score >= threshold - 1e-9
    return key[good] // n_items, key[good] % n_items, score[good]


def hits_in(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, question: float, answer: float):
    """Row, item, score and the two shares of every verified hit."""
    hashes, _, _, at = words(plain(data), offsets)
    if not len(hashes) or not len(index.terms):
        return []
    place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == hashes)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[known]
    half = index.longest
    count = np.maximum(1, -(-(np.diff(at) - half) // half))
    base = np.cumsum(count) - count
    k = (known - at[owner]) // half
    late = k < count[owner]
    early = k >= 1
    key = np.unique(np.concatenate([
        (base[owner] + k)[late] * len(index.terms) + place[known][late],
        (base[owner] + k - 1)[early] * len(index.terms) + place[known][early]]))
    out = []
    for passage, item, score in zip(*retrieve(index, key // len(index.terms), key % len(index.terms), threshold)):
        row = int(np.searchsorted(base, passage, "right")) - 1
        start = at[row] + (passage - base[row]) * half
        seen = hashes[start : min(start + 2 * half, at[row + 1])]
        shares = [float(np.isin(grams, runs(seen, n)).mean()) if n else 1.0 for n, grams in index.grams[item]]
        if shares[0] >= question and shares[1] >= answer:
            out.append((row, index.ids[item], float(score), shares[0], shares[1]))
    return out


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION_SHARE,
                 answer: float = ANSWER_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, item_id, score, question_share, answer_share) for each document and each test item that it holds.

    Items are distinct (item_id, text) rows; ids may be of any plain type, and NULL is an id like others. Items without
    words are not searched; of several passages with the same item the best score is given. NULL and empty texts hold
    nothing. The items are split by a hash into parts of about `part_bytes`, whatever their number.
    """
    ship(docs.sparkSession)
    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).where(
        F.col("text").isNotNull()).distinct()
    n_bytes = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(1, math.ceil(n_bytes / part_bytes))
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)).cast("int").alias("part")
    named = materialise(named.select(part_of, "item_id", "text"), "items")
    counted = item_terms(named)
    kind, item_kind = (picked.schema["key"].dataType.simpleString(), named.schema["item_id"].dataType.simpleString())
    item_type = to_arrow_type(named.schema["item_id"].dataType)
    found = None
    for part in range(n_parts):
        rows = named.where(F.col("part") == part).collect()
        index = docs.sparkSession.sparkContext.broadcast(
            Index([(r["item_id"], r["text"]) for r in rows], statistics_for(counted, part)))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, data, offsets in slices(batch.column(1)):
                    hits = hits_in(index.value, data, offsets, threshold, question, answer)
                    if hits:
                        row, item_id, *rest = zip(*hits)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0)[first:last].take(pa.array(row)), pa.array(item_id, item_type),
                             *map(pa.array, rest)],
                            names=["key", "item_id", "score", "question_share", "answer_share"])

        hits = picked.mapInArrow(
            search, f"key {kind}, item_id {item_kind}, score double, question_share double, answer_share double")
        hits = materialise(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    best = F.max(F.struct("score", "question_share", "answer_share")).alias("best")
    return found.groupBy("key", "item_id").agg(best).select(F.col("key").alias(key), "item_id", "best.*")


def item_terms(named: DataFrame) -> DataFrame:
    """Rows (part, term, frequency, n): for each part its distinct terms with the number of items of all parts that hold
    them, and a row without a part or term with the number of items, of their words, and of the longest item's words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, _ in slices(batch.column(1)):
                owner, hashes, n = terms_of(batch.column(1)[first:last])
                part = batch.column(0)[first:last]
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([part.take(pa.array(owner)), part]),
                    pa.array(np.append(hashes.view(np.int64), np.zeros(len(n), np.int64))),
                    pa.array(np.append(np.full(len(owner), -1), n).astype(np.int64))],
                    names=["part", "term", "n_words"])

    terms = materialise(
        named.select("part", "text").mapInArrow(count, "part int, term long, n_words long"), "item-terms")
    held = terms.where("n_words < 0").groupBy("part", "term").agg(F.count(F.lit(1)).alias("own"))
    frequency = held.groupBy("term").agg(F.sum("own").alias("frequency"))
    by_part = held.join(frequency, "term").select("part", "term", "frequency", F.lit(0).cast("long").alias("n"),
                                                  F.lit(0).cast("long").alias("most"))
    totals = terms.where("n_words >= 0").agg(
        F.count(F.lit(1)).alias("frequency"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n"),
        F.coalesce(F.max("n_words"), F.lit(0)).alias("most"))
    whole = totals.select(F.lit(None).cast("int").alias("part"), F.lit(0).cast("long").alias("term"), "frequency", "n", "most")
    return materialise(by_part.unionByName(whole), "item-statistics")


def statistics_for(counted: DataFrame, part: int) -> Statistics:
    """The statistics of all items for the terms of one part: as many rows as the part has distinct terms, plus one."""
    rows = counted.where(F.col("part").isNull() | (F.col("part") == part)).toArrow()
    own = rows["part"].is_valid().to_numpy()
    term = rows["term"].to_numpy().view(np.uint64)
    frequency, n, most = (rows[c].to_numpy() for c in ("frequency", "n", "most"))
    order = np.argsort(term[own])
    items = int(frequency[~own][0])
    return Statistics(items, int(n[~own][0]) / max(1, items), int(most[~own][0]), term[own][order], frequency[own][order])


def as_text(key: str) -> Column:
    """A key that can be joined, also where it is NULL."""
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no test item, with all their columns; rows with the same key share their hits."""
    hits = leaked_items(docs, items, key, **options).select(as_text(key).alias("__key")).distinct()
    left = docs.withColumn("__key", as_text(key)).join(materialise(hits, "leaked"), "__key", "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_decontamination(spark, folder: str) -> DataFrame:
    """One row per document: whether it holds test items, which ones, and the best score. An item with a NULL id counts,
    but is not listed."""
    docs = table(spark, folder, "documents")
    hits = leaked_items(docs, table(spark, folder, "benchmark"))
    listed = hits.groupBy(as_text("doc_id").alias("hit_key")).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("score"))
    rows = docs.select("doc_id", as_text("doc_id").alias("hit_key")).join(materialise(listed, "listed"), "hit_key", "left")
    return rows.select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.round("score", 6).alias("score"))
