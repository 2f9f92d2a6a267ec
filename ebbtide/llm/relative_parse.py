"""Substring deduplication by a relative parse: every document is factored against the indexed blocks of all documents.

A window is 35 consecutive words. Of its eight-word runs the one with the smallest hash is its anchor; equal windows have
the same anchor at the same place. Neighbouring windows with the same anchor form a block, so each window of each
document is in exactly one block (about eleven windows on average), and the index has one entry for each block.

Parsing a document against the index:
1. A block whose anchor occurs nowhere else cannot match: its windows start a new literal.
2. A block that occurs elsewhere as a whole is matched as a whole: all its windows are inside a factor.
3. Where blocks share an anchor but differ, a factor ends inside a block. Only there the windows are compared one by one:
   the factor boundary is checked. One copy of each different block is enough for that.
Matched windows that follow each other make up the factors. Each has 35 words or more, and its words are removed.

What is shuffled grows with the number of blocks (a tenth of the words), not with the words, and only blocks with a
repeated anchor go on. Counts are combined before each shuffle, and a frequent block meets its documents by plain joins
that adaptive execution splits. Rows are numbered once and written with their texts; all passes read that table, so a row
has one number however the input is split. Texts are shuffled twice, by row: for the check and for the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.tables import ship, table
from ebbtide.llm.text import ODD, mix, powers, runs, slices, word_bounds, words
from ebbtide.session import materialise

WINDOW, ANCHOR = 35, 8
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def blocks_of(hashes: np.ndarray, at: np.ndarray, window: int, anchor: int):
    """Anchor hash, block hash, row, first window (in its row) and number of windows of each block."""
    n = len(hashes) - window + 1
    none = np.zeros(0, np.uint64)
    if n <= 0:
        return none, none, *(np.zeros(0, np.int64) for _ in range(3))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = owner[:n] == owner[window - 1 :]
    grams = runs(hashes, anchor)
    spread = window - anchor + 1
    spot = np.empty(n, np.int64)
    step = 1 << 16
    for a in range(0, n, step):
        part = np.lib.stride_tricks.sliding_window_view(grams[a : a + step + spread - 1], spread)[: n - a]
        spot[a : a + len(part)] = part.argmin(1) + np.arange(a, a + len(part))
    valid = np.flatnonzero(inside)
    if not len(valid):
        return none, none, *(np.zeros(0, np.int64) for _ in range(3))
    new = np.ones(len(valid), bool)
    new[1:] = (spot[valid[1:]] != spot[valid[:-1]]) | (owner[valid[1:]] != owner[valid[:-1]])
    first = valid[np.flatnonzero(new)]
    count = np.diff(np.append(np.flatnonzero(new), len(valid)))
    end = first + count + window - 1
    power = powers(ODD, len(hashes))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power, dtype=np.uint64)])
    content = (upto[end] - upto[first]) * powers(INVERSE, len(hashes))[first]
    content = mix(content + (spot[first] - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
                  + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return grams[spot[first]], content, owner[first], first - at[owner[first]], count


def block_rows(docs: DataFrame, window: int, anchor: int, places: bool) -> DataFrame:
    """(anchor, block) of every block of `text`, and its (row, first, n) if `places`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                hashes, _, _, at = words(data, offsets)
                a, b, row, start, n = blocks_of(hashes, at, window, anchor)
                columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
                if places:
                    columns += [batch.column(0)[first:last].take(pa.array(row)), pa.array(start.astype(np.int32)),
                                pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "block", "row", "first", "n"][: len(columns)])

    more = ", row long, first int, n int" if places else ""
    return docs.select("row", "text").mapInArrow(cut, "anchor long, block long" + more)


def window_rows(texts: DataFrame, window: int) -> DataFrame:
    """(hash, row, first, alone) of each window of the blocks listed in `blocks` beside `row`, `key`, `text`."""

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, listed = batch.column(0).to_numpy(), batch.column(3)
            for first, last, data, offsets in slices(batch.column(2)):
                hashes, _, _, at = words(data, offsets)
                every = runs(hashes, window)
                part = listed[first:last]
                inner = part.flatten()
                start, n = inner.field(0).to_numpy().astype(np.int64), inner.field(1).to_numpy().astype(np.int64)
                alone = inner.field(2).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(last - first), pa.compute.list_value_length(part).to_numpy())
                rep = np.repeat(np.arange(len(n)), n)
                place = start[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[at[owner[rep]] + place].view(np.int64)), pa.array(rows[first:last][owner[rep]]),
                     pa.array(place.astype(np.int32)), pa.array(alone[rep])], names=["hash", "row", "first", "alone"])

    return texts.mapInArrow(list_windows, "hash long, row long, first int, alone boolean")


def kept_words(texts: DataFrame, window: int) -> DataFrame:
    """The result for each row of `row`, `key`, `text` and `spans` (window runs that are inside factors, or NULL)."""
    kind = texts.schema["key"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(2)):
                starts, ends = word_bounds(data, offsets)
                at = np.searchsorted(starts, offsets)
                part = batch.column(3)[first:last]
                lengths = np.nan_to_num(pa.compute.list_value_length(part).to_numpy(zero_copy_only=False)).astype(int)
                inner = part.flatten()
                owner = np.repeat(np.arange(last - first), lengths)
                mark = np.zeros(len(starts) + 1, np.int64)
                begin = at[owner] + inner.field(0).to_numpy()
                np.add.at(mark, begin, 1)
                np.add.at(mark, begin + inner.field(1).to_numpy() + window - 1, -1)
                gone = np.cumsum(mark)[:-1] > 0
                before = np.concatenate([[0], np.cumsum(gone)])
                raw, sums, spans = data.tobytes(), [], []
                for r in range(last - first):
                    a, b = at[r], at[r + 1]
                    if before[b] == before[a]:
                        text = b" ".join(raw[offsets[r] : offsets[r + 1]].split())
                        edges = []
                    else:
                        stay = np.flatnonzero(~gone[a:b]) + a
                        text = b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())])
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]]))).tolist()
                    sums.append(hashlib.sha256(text).hexdigest())
                    spans.append(edges)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[first:last], pa.array(np.diff(at).astype(np.int64)),
                     pa.array((before[at[1:]] - before[at[:-1]]).astype(np.int64)), pa.array(sums),
                     pa.array(spans, pa.list_(pa.int32()))],
                    names=["key", "n_words", "n_removed", "kept_sha256", "factor_edges"])

    return texts.mapInArrow(
        keep, f"key {kind}, n_words long, n_removed long, kept_sha256 string, factor_edges array<int>")


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR) -> DataFrame:
    """`key`, `n_words`, `n_removed`, `kept_sha256`, `factor_edges` for each input row.

    Removes every word covered by a window whose word sequence also starts elsewhere, in the same document too. Edges are
    word positions: begin and end of the first removed span, of the second, ... NULL and empty texts have no words.
    Repeated rows are each other's copies. Rows are numbered in one pass and written; no later pass reads `docs`.
    Windows are compared by 64-bit hashes, whole blocks by two of them.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = materialise(rows, "numbered")
    index = block_rows(rows, window, anchor, False).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("times"), F.min("block").alias("low"), F.max("block").alias("high"))
    index = materialise(index.where("times > 1").select("anchor", (F.col("low") != F.col("high")).alias("differ")),
                        "anchors")
    found = materialise(block_rows(rows, window, anchor, True).join(index, "anchor"), "blocks")
    differing = found.where("differ").groupBy("anchor", "block").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first", "n")).alias("one"))
    differing = materialise(differing.select("anchor", "block", "times", "one.row", "one.first", "one.n"), "differing")

    listed = differing.select("row", F.struct("first", "n", (F.col("times") == 1).alias("alone")).alias("b"))
    listed = listed.groupBy("row").agg(F.collect_list("b").alias("blocks"))
    near = rows.join(listed, "row").select("row", "key", "text", "blocks")
    windows = materialise(window_rows(near, window), "windows")
    twice = windows.groupBy("hash").count().where("count > 1").select("hash")
    inside = windows.where("alone").join(materialise(twice, "twice"), "hash")
    inside = materialise(inside.select("row", "first", F.lit(1).alias("n")), "inside")
    again = found.where("differ").join(differing.where("times > 1").select("anchor", "block"), ["anchor", "block"])
    again = materialise(again.select("row", "first", "n"), "again")
    whole = found.where("not differ").select("row", "first", "n").unionByName(again)
    spans = whole.unionByName(inside).groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    out = rows.join(materialise(spans, "spans"), "row", "left").select("row", "key", "text", "spans")
    return kept_words(out, window).withColumnRenamed("key", key)


def op2_relative_parse(spark, folder: str) -> DataFrame:
    return remove_repeated(table(spark, folder, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM p),
m AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
x AS (SELECT DISTINCT r, i + k AS j FROM g JOIN m USING (h), range(0, 35) t(k)),
v AS (SELECT r, doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
k AS (
  SELECT v.r, string_agg(v.word, ' ' ORDER BY v.j) AS kept, count(*) AS n
  FROM v LEFT JOIN x ON x.r = v.r AND x.j = v.j WHERE x.r IS NULL GROUP BY v.r),
s AS (
  SELECT v.r, v.j, x.j IS NOT NULL AS gone,
    lag(x.j IS NOT NULL, 1, false) OVER o AS was, lead(x.j IS NOT NULL, 1, false) OVER o AS next
  FROM v LEFT JOIN x ON x.r = v.r AND x.j = v.j WINDOW o AS (PARTITION BY v.r ORDER BY v.j)),
f AS (
  SELECT r, list(CAST(e AS INTEGER) ORDER BY e) AS factor_edges FROM (
    SELECT r, j - 1 AS e FROM s WHERE gone AND NOT was UNION ALL SELECT r, j AS e FROM s WHERE gone AND NOT next)
  GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256, coalesce(f.factor_edges, CAST([] AS INTEGER[])) AS factor_edges
FROM d LEFT JOIN k USING (r) LEFT JOIN f USING (r)
"""
