import math

import numpy as np
import pytest

from ebbtide.llm import spectral_whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def random_rotation(rng, n):
    return np.linalg.qr(rng.normal(size=(n, n)))[0]


def matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 16, 64):
        q = random_rotation(rng, n)
        spread = np.ones(n)
        spread[: n // 2] = 5
        near = np.linspace(1, 2, n)
        near[-1] = near[0]
        for values in (np.geomspace(1e6, 1e-2, n), spread, near, np.arange(n) % 3 + 0.0):
            yield (q * values) @ q.T
        yield np.eye(n) * 4
        yield np.diag(rng.random(n))
        low = rng.normal(size=(n, max(1, n // 3)))
        yield low @ low.T


def test_components_equal_those_of_a_direct_solver():
    for a in matrices():
        a = (a + a.T) / 2
        values, vectors = W.components(a, 8)
        size = np.linalg.norm(a) or 1.0
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:8], rtol=0, atol=1e-14 * size)
        assert np.linalg.norm(a @ vectors - vectors * values) < 1e-13 * size
        assert np.linalg.norm(vectors.T @ vectors - np.eye(vectors.shape[1])) < 1e-13


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(2)
    for values in ([3.0, -2.0, 1e-9, -1e-12, 5.0], [1.0, 1.0, 1.0], [-4.0]):
        q = random_rotation(rng, len(values))
        u = W.polar_factor((q * values) @ q.T)
        assert np.allclose(u, (q * np.sign(values)) @ q.T, atol=1e-3 if min(map(abs, values)) < 1e-6 else 1e-13)
        assert np.allclose(u @ u, np.eye(len(values)), atol=1e-12)


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for most in (10, 10**6, 2**40):
        x = rng.integers(-most, most, (50, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(3)] for i in range(3)]
        assert W.products(x).tolist() == want


def brute(rows, wanted=8):
    good = [(k, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for k, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[i] for _, x in good) for i in range(d)]
    exact = np.array([[n * c - s for c, s in zip(x, sums)] for _, x in good], object)
    covariance = (exact.T @ exact / (n * n * n)).astype(float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    white = (exact / n).astype(float) @ vectors / np.sqrt(values)
    return n, {k: (sum(int(v) ** 2 for v in e), w) for (k, _), e, w in zip(good, exact, white)}, values / np.trace(covariance)


def compare(got, rows, wanted=8):
    n, want, explained = brute(rows, wanted)
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], []).append(r)
    assert set(found) == set(want)
    signs = None
    for k, listed in found.items():
        listed.sort(key=lambda r: r["component"])
        assert [r["component"] for r in listed] == list(range(1, len(explained) + 1))
        assert all(r["n"] == n and r["deviation"] == want[k][0] and r["identity_error"] < 1e-9 for r in listed)
        white = np.array([r["whitened"] for r in listed])
        assert np.allclose([r["explained"] for r in listed], explained, rtol=1e-9)
        if signs is None and (np.abs(want[k][1]) > 1e-3).all():
            signs = np.sign(white * want[k][1])
    for k, listed in found.items():
        assert np.allclose(np.array([r["whitened"] for r in listed]) * signs, want[k][1], atol=1e-8)


def test_given_vectors(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(W.op11_whitening(spark, folder).collect(), rows)


def test_odd_rows_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=5) * [5, 1, 30, 2, 0.5] + 100]) for k in range(60)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan] * 5), (103, [1.0, math.inf, 1.0, 1.0, 1.0]),
             (104, [1.0, 2.0]), (105, []), (106, [1e30] * 5), (107, [-0.0, 0.0, 1e-30, -1e-30, 5.0])]
    counted = [r for r in rows if r[0] not in (104, 105, 106)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", component string, n int").repartition(3)
    compare(W.whiten(docs).collect(), counted)
    twice = spark.createDataFrame(rows * 2, SCHEMA)
    assert W.whiten(twice).count() == 2 * W.whiten(docs).count()
    assert W.whiten(spark.createDataFrame([(None, r[1]) for r in rows], SCHEMA)).where("vec_id is null").count() == 61 * 5


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=3) * 1e6]) for k in range(40)]
    n, want, _ = brute(rows)
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {
        k: v if v < 1 << 63 else None for k, (v, _) in want.items()}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, []), (2, [])]])
def test_tables_without_spread(spark, rows):
    got = W.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 0


def test_fewer_components_than_dimensions(spark):
    rows = [(k, [float(k), float(2 * k), 1.0]) for k in range(10)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and all(r["explained"] == pytest.approx(1) for r in got)
