import itertools
import random

import numpy as np
import pytest

from ebbtide.llm import part_enum as P
from ebbtide.llm.blocks import with_possible_partner
from ebbtide.llm.grams import packed

SCHEMA = "doc_id long, text string"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.split()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    low = {g: min([k for k in keys if k is not None], default=None) for g, keys in groups.items()}
    return sorted(((k, len(sets[i]), low[root(i)]) for i, (k, _) in enumerate(rows)), key=str)


def edited(rnd, base, edits):
    text = list(base)
    for _ in range(edits):
        text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
    return " ".join(text)


def group(seed, n, length, edits):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(length)]
    return [edited(rnd, base, rnd.randrange(edits + 1)) for _ in range(n)]


def test_linked_sizes_share_a_band():
    for size in range(1, 3000):
        first = P.bands_of(size)[0]
        assert first <= size <= P.band_end(first)
        for other in range(size, size * 100 // 90 + 1):  # sizes that can be linked
            common = set(P.bands_of(size)) & set(P.bands_of(other))
            assert common and all((size + other) // 19 <= P.most_different(tag) for tag in common)


def test_sets_within_the_limit_share_a_signature():
    rng = np.random.default_rng(3)
    for size in (10, 13, 19, 25, 40, 100, 333, 1000):
        for _ in range(20):
            one = rng.integers(0, 2**63, size).astype(np.uint64)
            swap = 0
            while 100 * (size - swap - 1) >= 90 * (size + swap + 1):  # as many features replaced as a link allows
                swap += 1
            other = np.concatenate([one[swap:], rng.integers(0, 2**63, swap).astype(np.uint64)])
            values, ends = np.concatenate([one, other]), np.array([0, size, 2 * size])
            for tag in P.bands_of(size):
                made = P.signatures(values, ends, tag, P.LEAST, P.FEATURES)
                assert len(set(made[0]) & set(made[1])) > 0


def test_a_plan_leaves_no_pair_out():
    first = 1
    while first < 20000:
        n1, n2, k2 = P.plan(first)
        assert k2 == P.most_different(first) // n1 and n2 > k2
        first = P.band_end(first) + 1


def test_shingles_equal_a_plain_loop():
    texts = ["A b C d", "a  B\nc d", "x", "X y", "", "a a a a a", "ÄB äb ÄB", "a\u00a0b c"]
    row, _, size = P.shingle_sets(*packed(texts))
    assert list(size) == [len(shingles(t.replace("\u00a0", "_"))) for t in texts]
    assert list(np.bincount(row, minlength=len(texts))) == list(size)


def test_components_against_brute_force(spark):
    rows = [*group(1, 60, 150, 7), *group(2, 30, 400, 25), *group(3, 30, 25, 1), *group(4, 40, 12, 1), "a b", "A  B", "a",
            "a b c", "a b c a b c", "", None, " ", *["one two three four"] * 3, *[f"only {k} here now" * 5 for k in range(20)]]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(rows)] + [(None, "a B"), (None, "zz"), (5000, rows[0]), (5000, rows[70])]
    docs = spark.createDataFrame([(*r, "v", 1) for r in rows], SCHEMA + ", node string, size int").repartition(5)
    got = sorted(map(tuple, P.jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_buckets_of_several_components_are_compared_completely(spark, monkeypatch):
    monkeypatch.setattr(P, "PIVOT_ROUNDS", -1)
    rows = [(k, t) for k, t in enumerate([*group(5, 70, 60, 4), *group(6, 20, 200, 9)])]
    got = P.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("least", [(70, 100), (95, 100)])
def test_other_similarities(spark, least):
    rows = [(k, t) for k, t in enumerate(group(8, 50, 80, 9))]
    sets = [shingles(t) for _, t in rows]
    links = {(i, j) for i, j in itertools.combinations(range(50), 2)
             if least[1] * len(sets[i] & sets[j]) >= least[0] * len(sets[i] | sets[j])}
    got = {r["doc_id"]: r["component_id"] for r in P.jaccard_components(
        spark.createDataFrame(rows, SCHEMA), least=least).collect()}
    low = list(range(50))
    for _ in range(50):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    assert [got[k] for k in range(50)] == low


def test_hot_groups_long_texts_and_one_key_for_many_rows(spark):
    rows = [(k, "same words in all of these " * 3) for k in range(300)] + [(7, t) for t in group(9, 100, 40, 2)]
    long = " ".join(f"v{k % 30011}" for k in range(120000))
    rows += [(1000, long), (1001, long + " and a bit more"), (1002, "")]
    got = sorted(map(tuple, P.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert P.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_pair_is_kept_in_one_of_its_buckets(spark):
    """Every pair that the sketches allow stays together somewhere, and only in the first bucket that it shares."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 9, (5, 16))
    counts = {k: (base[k % 5] + (rng.random(16) < 0.1)).tolist() for k in range(50)}
    sketches = spark.createDataFrame([(k, c, sum(c)) for k, c in counts.items()], "node long, sketch array<int>, features long")
    held = {b: sorted(rng.choice(50, 25 if b < 3 else 8, replace=False).tolist()) for b in range(12)}
    held[20], held[21] = held[0], held[5]
    mixed = [(b, k, k // 10) for b, nodes in held.items() for k in nodes]
    got = with_possible_partner(
        spark.createDataFrame(mixed, "band long, node long, root long"), sketches, (19, 1), once=True)
    want = set()
    for u, v in itertools.combinations(range(50), 2):
        apart = sum(abs(x - y) for x, y in zip(counts[u], counts[v]))
        shared = sorted((-len(nodes), b) for b, nodes in held.items() if u in nodes and v in nodes)
        if shared and u // 10 != v // 10 and 19 * apart <= sum(counts[u]) + sum(counts[v]):
            want |= {(shared[0][1], u), (shared[0][1], v)}
    assert {(r["band"], r["node"]) for r in got.select("band", "node").collect()} == want and want
