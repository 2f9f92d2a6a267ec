import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ebbtide.llm import bm25_index as B
from ebbtide.llm.text import raw_texts

SCHEMA = "doc_id long, text string"


def items_and_docs(seed=1, n_items=60, n_docs=150):
    rnd = random.Random(seed)
    common = "the of and to in a".split()
    word = lambda: rnd.choice(common) if rnd.random() < 0.4 else f"w{rnd.randrange(1500)}"
    items = [(k, " ".join(word() for _ in range(rnd.randrange(12, 60))) + ". " + " ".join(
        word() for _ in range(rnd.randrange(1, 9))) + ".") for k in range(n_items)]
    docs, truth = [], {}
    for k in range(n_docs):
        text = [word() for _ in range(rnd.randrange(0, 400))]
        if k % 5 == 0:
            item = rnd.randrange(n_items)
            at = rnd.randrange(len(text) + 1)
            text[at:at] = items[item][1].upper().split() if k % 2 else items[item][1].split()
            truth[k] = item
        docs.append((k, " ".join(text)))
    return items, docs, truth


def test_retrieval_equals_scoring_everything():
    items, docs, _ = items_and_docs()
    index = B.Index(items)
    rng = np.random.default_rng(2)
    dense = np.zeros((len(index.terms), len(items)))
    for t in range(len(index.terms)):
        for p in range(index.first[t], index.first[t + 1]):
            dense[t, index.item[p]] = index.weight[p]
    assert dense.sum(0) == pytest.approx(np.ones(len(items)))
    passages = [np.sort(rng.choice(len(index.terms), rng.integers(1, 200), replace=False)) for _ in range(80)]
    passage = np.repeat(np.arange(80), [len(p) for p in passages])
    for threshold in (0.05, 0.1, 0.2, 0.5):
        got = {(p, i): s for p, i, s in zip(*B.retrieve(index, passage, np.concatenate(passages), threshold))}
        every = {(p, i): s for p in range(80) for i, s in enumerate(dense[passages[p]].sum(0)) if s >= threshold - 1e-9}
        assert got.keys() == every.keys()
        assert all(got[k] == pytest.approx(every[k]) for k in got)


@pytest.mark.parametrize("part_bytes", [B.PART_BYTES, 2000])
def test_planted_items_are_found_and_nothing_else(spark, part_bytes):
    items, docs, truth = items_and_docs()
    hits = B.leaked_items(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"),
                          part_bytes=part_bytes).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == set(truth.items())
    assert all(r["score"] == pytest.approx(1) and r["question_share"] == r["answer_share"] == 1 for r in hits)


def test_question_without_answer_is_kept(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta. omega psi chi phi upsilon.")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "x Alpha, beta gamma delta epsilon "
                                  "zeta: OMEGA psi chi phi upsilon y")], SCHEMA)
    assert [r["doc_id"] for r in B.leaked_items(docs, items).collect()] == [2]


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta."), (2, None), (3, ""), (4, "solo")],
                                  "item_id long, text string")
    rows = [(1, None, "v"), (2, "", "v"), (None, "alpha beta gamma delta", "v"), (3, "alpha beta gamma delta", "v"),
            (3, "alpha beta gamma delta", "v"), (4, "delta gamma beta alpha", "v"), (5, "x solo", "v")]
    docs = spark.createDataFrame(rows, SCHEMA + ", score string")
    hits = {(r["doc_id"], r["item_id"]) for r in B.leaked_items(docs, items).collect()}
    assert hits == {(None, 1), (3, 1), (5, 4)}
    left = B.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4]
    none = spark.createDataFrame([], SCHEMA)
    assert B.leaked_items(none, items).count() == 0
    assert B.decontaminate(docs, items.limit(0)).count() == len(rows)


def test_case_and_punctuation():
    data, _ = raw_texts(pa.array(["ÉÀ, Straße 7!"]))
    assert B.plain(data).tobytes().decode() == "éà  straße 7 "


def near_copies(seed=4):
    """Items, and documents that hold a random part of an item's words, so that scores lie around the threshold."""
    items, _, _ = items_and_docs(seed)
    rnd = random.Random(seed)
    docs = []
    for k in range(200):
        kept = [w for w in items[k % len(items)][1].split() if rnd.random() < 0.3 + k % 7 / 10]
        docs.append((k, " ".join(kept)))
    return items, docs


def test_scores_near_the_threshold_do_not_depend_on_parts(spark):
    items, docs = near_copies()
    rows = spark.createDataFrame(docs, SCHEMA)
    given = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for part_bytes in (B.PART_BYTES, 3000, 700):
        hits = B.leaked_items(rows, given, part_bytes=part_bytes, question=0.0, answer=0.0).collect()
        got.append({(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in hits})
    assert got[0] == got[1] == got[2]
    assert 50 < len(got[0]) < 200 and sum(0.5 <= s < 0.6 for s in got[0].values()) > 3


def test_statistics_cover_all_items(spark):
    items, _, _ = items_and_docs(3, 40, 0)
    texts = [t for _, t in items]
    named = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "part int, text string")
    counted = B.item_terms(named.repartition(4))
    whole = B.Statistics.of(texts)
    for part in range(3):
        got, own = B.statistics_for(counted, part), B.Statistics.of([t for k, t in enumerate(texts) if k % 3 == part])
        assert (got.items, got.most_words) == (whole.items, whole.most_words)
        assert got.mean_words == pytest.approx(whole.mean_words) and (got.terms == own.terms).all()
        assert (got.frequency == whole.frequency[np.searchsorted(whole.terms, got.terms)]).all()


def test_many_short_items_in_bounded_memory():
    rnd = random.Random(5)
    items = [(k, " ".join(f"w{rnd.randrange(3000)}" for _ in range(8)) + ".") for k in range(20000)]
    index = B.Index(items)
    text = " ".join(f"w{rnd.randrange(3000)}" for _ in range(300_000)) + " " + items[7][1]
    data, offsets = raw_texts(pa.array([text]))
    tracemalloc.start()
    hits = B.hits_in(index, data, offsets, 0.5, 0.6, 0.6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in {h[1] for h in hits} and peak < 300 << 20


def test_ids_of_items(spark):
    text = "alpha beta gamma delta epsilon."
    docs = spark.createDataFrame([(1, "x " + text + " y"), (2, "other words")], SCHEMA)
    rows = [("a", text), ("a", text), ("b", "zeta eta theta iota."), (None, text)]
    hits = B.leaked_items(docs, spark.createDataFrame(rows, "item_id string, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"] or "") for r in hits) == [(1, ""), (1, "a")]
    once = B.leaked_items(docs, spark.createDataFrame(rows[1:], "item_id string, text string")).collect()
    assert {r["item_id"]: r["score"] for r in hits} == pytest.approx({r["item_id"]: r["score"] for r in once})
