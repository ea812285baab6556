"""The resumable loop against NumPy; publishing under retries, failures and rivals."""

import numpy as np
import pytest

from hopweave.operators import training as T
from hopweave.sources import publishing as P


def data(spark, n=60, dims=3, classes=4):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(n, dims)), r.integers(0, classes, n)
    return x, y, spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "node bigint, vec array<double>").repartition(5), spark.createDataFrame([(i, int(y[i])) for i in range(n)], "node bigint, label int")


def by_numpy(x, y, classes, steps, rate=0.05):
    w = np.zeros((x.shape[1], classes))
    m, v, losses = np.zeros_like(w), np.zeros_like(w), []
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        g = x.T @ (p - np.eye(classes)[y]) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, losses


def weights_of(state, dims, classes):
    out = np.zeros((dims, classes))
    for r in state.collect():
        out[r.i, r.k] = r.value
    return out


def test_losses_and_weights_equal_numpy_and_a_stop_changes_nothing(spark, tmp_path):
    x, y, xs, ys = data(spark)
    w0 = [[0.0] * 4 for _ in range(3)]
    want, losses = by_numpy(x, y, 4, 5)
    state = T.train(xs, ys, w0, 4, f"{tmp_path}/a", 5)
    assert np.allclose(weights_of(state, 3, 4), want, atol=1e-9)
    assert {r.step: pytest.approx(r.loss) for r in T.losses_of(spark, f"{tmp_path}/a").collect()} == dict(enumerate(losses, 1))
    # stopped after two steps, with the third half written
    T.train(xs, ys, w0, 4, f"{tmp_path}/b", 2)
    (tmp_path / "b" / "step=00000003").mkdir()
    (tmp_path / "b" / "step=00000003" / "part-0.parquet").write_bytes(b"half")
    assert T.written_steps(spark, f"{tmp_path}/b") == [0, 1, 2]
    again = T.train(xs, ys, [[9.0] * 4] * 3, 4, f"{tmp_path}/b", 5)
    assert np.array_equal(weights_of(again, 3, 4), weights_of(state, 3, 4)) or np.allclose(weights_of(again, 3, 4), want, atol=1e-12)
    assert T.written_steps(spark, f"{tmp_path}/b") == [0, 1, 2, 3, 4, 5]


SCHEMA = "system string, seconds double"


def seen(spark, path):
    return sorted((r.run, r.system, r.seconds) for r in P.published(spark, path, SCHEMA).collect())


def test_a_rerun_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/results"
    assert seen(spark, path) == []
    rows = spark.createDataFrame([("a", 1.5), ("b", 2.0)], SCHEMA)
    assert P.publish(rows, path, "one") == 1 and P.publish(rows, path, "one") == 2
    assert seen(spark, path) == [("one", "a", 1.5), ("one", "b", 2.0)]
    P.publish(rows.where("system = 'a'"), path, "two")
    assert seen(spark, path) == [("one", "a", 1.5), ("one", "b", 2.0), ("two", "a", 1.5)]
    assert P.sweep(spark, path) == 1 and len(seen(spark, path)) == 3


def test_a_run_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/results", spark.createDataFrame([("a", 1.0)], SCHEMA)
    P.publish(rows, path, "one")
    with monkeypatch.context() as m:
        m.setattr(P, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            P.publish(rows, path, "two")
    assert seen(spark, path) == [("one", "a", 1.0)]
    P.publish(rows, path, "two")
    assert [r[0] for r in seen(spark, path)] == ["one", "two"]


def test_rivals_both_end_up_in_it(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/results", spark.createDataFrame([("a", 1.0)], SCHEMA)
    real, met = P._commit, []

    def late(spark_, path_, number, runs):
        if not met:  # a rival takes this number first
            met.append(number)
            assert real(spark_, path_, number, {"rival": "runs/rival-x"})
        return real(spark_, path_, number, runs)

    rows.write.option("sep", "|").option("header", True).csv(f"{path}/runs/rival-x")
    monkeypatch.setattr(P, "_commit", late)
    assert P.publish(rows, path, "mine") == 2
    assert [r[0] for r in seen(spark, path)] == ["mine", "rival"]
