import pytest

from ebbtide.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def fill(sizes, weights, share, most):
    """Resharing by weight until no source is above its limit."""
    targets, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        total = sum(weights[s] for s in open_)
        targets = {s: most * sizes[s] for s in full} | {s: left * weights[s] / total for s in open_}
        above = {s for s in open_ if targets[s] > most * sizes[s]}
        if not above:
            return targets
        full |= above


def expected_targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    return fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2), sizes


@pytest.mark.parametrize("n_sources", [1, 2, 3, 7, 20])
def test_targets_and_taken_words(spark, n_sources):
    rows = [(k, "w " * (1 + k * 7 % 23), None if k % n_sources == 4 else f"s{k % n_sources % (k % 5 + 1)}")
            for k in range(400)]
    targets, sizes = expected_targets(rows)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 400
    source_of = {k: s for k, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["target"] == pytest.approx(targets[s], abs=1e-5)
        assert r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 12


def test_reruns_agree_in_any_partitioning(spark):
    rows = [(k, "w " * (k % 9), f"s{k % 4}") for k in range(200)]
    one = sorted(mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())
    two = sorted(mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect())
    assert one == two


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "x \t\x0b y z", "a")]
    got = {(r["doc_id"], r["size"]): r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 0]["source_size"] == 0 and got[1, 0]["taken"] == 0
    assert got[3, 2]["source_size"] == 4 and got[None, 2]["target"] == pytest.approx(6.0)


def test_empty_table_and_clashing_columns(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b", "s", 7, "t"), (2, "a", "s", 8, "u")],
                                 SCHEMA + ", size int, target string")
    got = mixing.mix_documents(docs)
    assert got.columns == [*docs.columns, "mix_size", "mix_target", "mix_taken"]
    assert {(r["doc_id"], r["size"], r["target"]) for r in got.collect()} <= {(1, 7, "t"), (2, 8, "u")}


def test_a_frequent_key_is_split_by_its_texts(spark):
    rows = [(7 if k % 2 else k, f"t{k} " * 3, "s" if k % 4 else "r") for k in range(400)]
    targets, sizes = expected_targets(rows)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in sizes:
        taken = sum(r["taken"] for r in got if r["source_size"] == sizes[s])
        assert abs(taken - targets[s]) <= 3
