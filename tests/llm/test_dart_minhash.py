import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import dart_minhash as D
from ebbtide.llm.blocks import block_pairs, compare_buckets, with_possible_partner
from ebbtide.llm.components import components
from ebbtide.llm.text import bounded

SCHEMA = "doc_id long, text string"


def bag(text):
    w = (text or "").split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            if both and both >= 0.8 * sum((a | bags[j]).values()) - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for k, t in rows:
        groups.setdefault(root(texts.index(t or "")), []).append(k)
    low = lambda g: min([k for k in g if k is not None], default=None)
    return sorted(((k, low(g), len(g)) for g in groups.values() for k in g), key=str)


def near_group(seed, n, edits):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(900)}" for _ in range(120)]
    rows = []
    for k in range(n):
        text = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
        rows.append(" ".join(text))
    return rows


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 5, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    b[:200] = a[:200]
    a[:40] *= 1.5
    row = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    signature = D.dart_signatures(row, np.concatenate([elements[a > 0], elements[b > 0]]),
                                  np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    assert (signature != 0).all()
    similarity = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (signature[0] == signature[1]).mean() == pytest.approx(similarity, abs=0.04)


def test_signature_does_not_depend_on_the_other_rows():
    element = np.arange(1, 50, dtype=np.uint64) * np.uint64(977)
    alone = D.dart_signatures(np.zeros(49, int), element, np.ones(49), 1, 64)
    both = D.dart_signatures(np.repeat([0, 1], 49), np.concatenate([element + np.uint64(5), element]), np.ones(98), 2, 64)
    assert (alone[0] == both[1]).all()


def test_classes(spark):
    rows = [*near_group(1, 60, 12), *near_group(2, 25, 3), *[f"only {k} " * 9 for k in range(30)], "a b", "a b", "a  b",
            "one two three four", "", None, " ", "w " * 40, "w " * 41, "w " * 60]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(rows)] + [(None, "a b"), (5000, rows[0])]
    docs = spark.createDataFrame([(*r, "v") for r in rows], SCHEMA + ", node string")
    got = D.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    left = D.drop_near(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == {c for _, c, _ in brute(rows)}


def test_whole_buckets_are_compared_in_blocks(spark):
    rows = [*enumerate(near_group(5, 80, 14)), *enumerate(near_group(6, 30, 2), 100)]
    nodes = spark.createDataFrame([(k, t, len(t) / 4) for k, t in rows], "node long, text string, size double")
    # nodes from 100 on are one component already; one bucket is repeated, one is a part of another
    mixed = spark.createDataFrame([(b, k, min(k, 100)) for k, _ in rows for b in (1, 2)] + [(3, 4, 4), (3, 9, 9)],
                                  "band long, node long, root long")
    similar = lambda both, one, other: both >= 0.8 * (one + other - both) - 1e-6
    for most in (300, 1 << 17):
        links = compare_buckets(mixed, nodes, "text", D.layered, similar, most)
        links = links.unionByName(spark.createDataFrame([(k, 100) for k in range(101, 130)], "u long, v long"))
        found = {r["node"]: r["root"] for r in components(links.select("u", "v")).collect()}
        assert sorted((k, found.get(k, k)) for k, _ in rows) == [(k, c) for k, c, _ in sorted(brute(rows))]


def test_blocks_are_bounded_and_leave_out_one_component(spark):
    rows = [(1, k, 7 if k < 900 else k, 10.0) for k in range(1000)] + [(2, k, 7, 10.0) for k in range(500)]
    mixed = spark.createDataFrame(rows, "band long, node long, root long, size double")
    placed, pairs = block_pairs(mixed, 1000)
    sizes = {(r["band"], r["block"]): r["n"] for r in placed.groupBy("band", "block").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("root").alias("roots")).collect()}
    assert sum(n for (band, _), n in sizes.items() if band == 1) == 1000 and max(sizes.values()) < 200
    root = {r["node"]: r["root"] for r in placed.where("band = 1").collect()}
    block = {r["node"]: r["block"] for r in placed.where("band = 1").collect()}
    listed = {(r["i"], r["j"]) for r in pairs.where("band = 1").collect()}
    for a in range(0, 1000, 13):
        for b in range(0, 1000, 7):
            if root[a] != root[b]:
                assert tuple(sorted((block[a], block[b]))) in listed
    large = {block[k] for k in range(900)}
    assert pairs.where("band = 2").count() == 0 and not any(i in large and j in large for i, j in listed)


def test_sketches_leave_out_only_what_cannot_be_linked(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 9, (6, 16))
    counts = {k: (base[k % 6] + (rng.random(16) < 0.1)).tolist() for k in range(60)}
    sketches = spark.createDataFrame([(k, c, sum(c)) for k, c in counts.items()], "node long, sketch array<int>, features long")
    mixed = [(1, k, k // 12 * 12) for k in range(60)] + [(2, k, k // 12 * 12) for k in range(20)]
    got = with_possible_partner(spark.createDataFrame(mixed, "band long, node long, root long"), sketches, (19, 1))
    want = set()
    for b, u, r in mixed:
        for c, v, s in mixed:
            apart = sum(abs(x - y) for x, y in zip(counts[u], counts[v]))
            if b == c and r != s and 19 * apart <= sum(counts[u]) + sum(counts[v]):
                want.add((b, u))
    assert {(r["band"], r["node"]) for r in got.collect()} == want and 0 < len(want)


def test_long_pairs_are_compared_alone():
    texts = pa.array(["a" * 10, "b" * 500, None, "c", "d" * 90])
    assert list(bounded([texts, texts], 100)) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    assert list(bounded([texts.slice(0, 0)], 100)) == []


def test_components_of_chains_and_loops(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (100, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert D.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
