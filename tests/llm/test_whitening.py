"""Block Lanczos and whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from hopweave.llm import whitening as W

VECS = "vec_id long, embedding array<float>"


def brute(rows, k=32):
    """(vec_id, deviation), whitened rows up to sign, explained, by the covariance itself."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([np.array(v, np.float32).astype(float) for _, v in good])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-13 * values.sum()).sum()))
    dev = [sum(int(e) ** 2 for e in r) for r in (n * x - s)]
    return [i for i, _ in good], dev, y @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(rows, got, tolerance=1e-8):
    ids, dev, white, explained = brute(rows)
    k = white.shape[1]
    assert len(got) == len(ids) * k
    by = {}
    for r in got:
        by.setdefault((str(r.vec_id), r.deviation, r.component), []).append(r)
        assert r.n == len(ids) and r.identity_error <= 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    for c in range(k):
        mine = [next(iter(by[str(i), d, c + 1])).whitened for i, d in zip(ids, dev, strict=True)]
        sign = np.sign(np.dot(mine, white[:, c]))
        assert np.abs(sign * np.array(mine) - white[:, c]).max() < tolerance


def clusters(n, d, seed=1):
    r = np.random.default_rng(seed)
    return [(i, [float(c) for c in (r.standard_normal(d) * np.linspace(1, 0.3, d) + 3 * (i % 5)).astype(np.float32)]) for i in range(n)]


def test_equals_the_covariance(spark):
    rows = clusters(400, 40)
    df = spark.createDataFrame(rows, VECS).repartition(6)
    check(rows, W.whiten(df, "vec_id", "embedding").collect())


def test_nulls_repeats_and_other_lengths(spark):
    rows = clusters(60, 5)
    rows += [rows[3], rows[3], (None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, VECS)
    got = W.whiten(df, "vec_id", "embedding").collect()
    assert {r.vec_id for r in got} == {i for i, _ in rows}
    check(rows, got)


def test_few_directions(spark):
    """Repeated rows and constant entries leave fewer directions than asked for: those alone are returned."""
    rows = [(i, [float(i % 3), 1.0, float(i % 2), float(i % 3)]) for i in range(30)]
    got = W.whiten(spark.createDataFrame(rows, VECS), "vec_id", "embedding").collect()
    assert {r.component for r in got} == {1, 2}
    check(rows, got)
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 4, VECS)
    assert W.whiten(same, "vec_id", "embedding").collect() == []
    assert W.whiten(spark.createDataFrame([], VECS), "vec_id", "embedding").collect() == []


def test_clashing_columns_and_string_ids(spark):
    rows = clusters(30, 4)
    df = spark.createDataFrame([(f"v{i}", v, 1, "x", 2.0) for i, v in rows], "id string, vector array<float>, n int, component string, whitened double")
    got = W.whiten(df, "id", "vector").collect()
    check([(f"v{i}", v) for i, v in rows], got)


def test_large_entries(spark):
    """Deviations that a long can't hold are null; the rest stays right."""
    rows = [(i, [float((i * 7919) % 1000) * 1e5, float(i % 7)]) for i in range(2000)]
    got = W.whiten(spark.createDataFrame(rows, VECS), "vec_id", "embedding").collect()
    assert {r.component for r in got} <= {1, 2} and all(r.identity_error < 1e-6 for r in got)
    ids, dev, *_ = brute([(i, [min(v[0], W.LARGEST), v[1]]) for i, v in rows])
    want = {i: (d if d < 1 << 63 else None) for i, d in zip(ids, dev, strict=True)}
    assert any(v is None for v in want.values())
    assert all(r.deviation == want[r.vec_id] for r in got)


def dense(values, seed=5):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values,k,block,most",
    [
        (np.geomspace(1, 1e-6, 300), 8, 4, 10_000),  # residuals end it before the basis is the whole space
        (np.geomspace(1, 1e-3, 300), 8, 4, 40),  # restarts
        (np.concatenate([np.full(5, 2.0), np.linspace(1, 0.1, 95)]), 10, 3, 10_000),  # a value five times, a block of three
        (np.concatenate([[3.0, 2.0], np.zeros(48)]), 6, 4, 10_000),  # breakdown: two directions in all
        (np.linspace(2, 1, 16), 16, 16, 10_000),  # one block is the whole space
        (np.linspace(2, 1, 10), 4, 16, 10_000),  # a block wider than the space
    ],
)
def test_lanczos(values, k, block, most):
    a = dense(values)
    got, vectors, passes = W.block_lanczos(lambda v: a @ v, len(values), k, block, 1e-12, most)
    want = np.sort(values)[::-1][: min(k, len(values))]
    assert np.allclose(got, want, atol=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-10
    if len(values) == 300 and most > 300:
        assert passes * block < 300


def test_lanczos_says_when_it_has_not_converged():
    a = dense(np.linspace(1, 0.99, 200))
    with pytest.raises(ArithmeticError):
        W.block_lanczos(lambda v: a @ v, 200, 2, 2, 1e-15, 10, most_passes=5)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = W.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, W.op12_whitening(spark, sf).collect())
