"""Small parts that no query shows: settings, caps, loops over batches, caller's folds, size model, ranks, kept tables."""

import numpy as np
import pytest

from hopweave.operators import aggregation as A
from hopweave.operators import caching as C
from hopweave.operators import ingest as I
from hopweave.operators import sampling as S
from hopweave.plans.config import SampleConfig
from hopweave.sources import kept as K


def test_settings_from_text():
    got = SampleConfig.parse(fanouts="20,20,-1", batch_size="4096", cache_fraction="0.5", model="pairwise")
    assert got == SampleConfig(4096, (20, 20, -1), 1, 4, 0.5, "pairwise", 1)
    with pytest.raises(ValueError):
        SampleConfig.parse(workers="4")


def test_caps_and_loops_over_batches(spark):
    batches = S.make_batches(spark.range(50).withColumnRenamed("id", "node"), 8)
    assert S.first_batches(batches, 2).count() == 16
    got = [(b, rows.count()) for b, rows in S.each_batch(batches)]
    assert got == [(i, 8) for i in range(6)] + [(6, 2)]


@pytest.mark.parametrize("numbers", [8_000_000, 4])
def test_a_callers_fold_sees_sources_in_id_order(spark, monkeypatch, numbers):
    """Many destinations at once, padded, or a few at a time."""
    monkeypatch.setattr(A, "FOLD_NUMBERS", numbers)
    block = spark.createDataFrame([(3, 9), (1, 9), (2, 9), (1, 8), (2, 7), (3, 7)], "src long, dst long")
    h = spark.createDataFrame([(i, [float(i), 10.0]) for i in range(1, 4)], "node long, vec array<double>")

    def fold(x, lengths):
        return x[:, 0] - x[np.arange(len(x)), lengths - 1] + lengths[:, None]

    got = {r["node"]: r["vec"] for r in A.reduce_with(block, h, fold).collect()}
    assert got == {9: [1.0, 3.0], 8: [1.0, 1.0], 7: [1.0, 2.0]}
    assert A.reduce_with(block.where("false"), h, fold).count() == 0


def test_padding_keeps_every_row():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 9, 50)
    values = r.normal(size=(lengths.sum(), 3))
    ends, seen = np.cumsum(lengths), []
    for places, x in A.padded(values, lengths):
        for i, rows in zip(places.tolist(), x):
            seen.append(i)
            assert np.array_equal(rows[: lengths[i]], values[ends[i] - lengths[i] : ends[i]]) and not rows[lengths[i] :].any()
    assert sorted(seen) == list(range(50))


@pytest.mark.parametrize("hidden", [2, 64])
def test_lstm_equals_a_plain_cell(spark, hidden):
    """Destinations of different numbers of sources, states shorter and longer than inputs."""
    dims, r = 12, np.random.default_rng(7)
    vec = {i: r.normal(size=dims).tolist() for i in range(20)}
    near = {d: sorted(r.choice(20, n, replace=False).tolist()) for d, n in ((100, 1), (101, 5), (102, 5), (103, 20))}
    block = spark.createDataFrame([(i, d) for d, ids in near.items() for i in reversed(ids)], "src long, dst long")
    h = spark.createDataFrame(list(vec.items()), "node long, vec array<double>")
    w, u = r.normal(0, 0.3, (dims, 4 * hidden)), r.normal(0, 0.3, (hidden, 4 * hidden))
    sig = lambda z: 1 / (1 + np.exp(-z))
    got = {row["node"]: row["vec"] for row in A.lstm_reduce(block, h, w.tolist(), u.tolist()).collect()}
    assert set(got) == set(near)
    for d, ids in near.items():
        state = cell = np.zeros(hidden)
        for i in ids:
            f_i, f_f, f_o, f_g = np.split(np.array(vec[i]) @ w + state @ u, 4)
            cell = sig(f_f) * cell + sig(f_i) * np.tanh(f_g)
            state = sig(f_o) * np.tanh(cell)
        assert np.allclose(got[d], state)


def test_size_model():
    assert C.size_model(1000, 64, [10, 5], 16) == {"cache_gb": 1000 * 64 * 4 / 2**30, "frame_rows": 1200}
    assert C.size_model(1000, 64, [10, -1], 16)["frame_rows"] == 1000


def test_ranks_in_two_steps(spark):
    rows = [(i, i % 3, (i * 7) % 5) for i in range(200)]
    got = {(r["g"], r["node"]): r["_r"] for r in I.ranked_down(spark.createDataFrame(rows, "node long, g long, v long"), ["g"], "v", chunk=16).collect()}
    for g in range(3):
        want = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))
        assert [got[g, x[0]] for x in want] == list(range(1, len(want) + 1))


def test_sorted_edges(spark):
    edges = spark.createDataFrame([(2, 1), (1, 9), (1, 3), (0, 7)], "src long, dst long")
    assert [tuple(r) for r in I.sorted_edges(edges).collect()] == [(0, 7), (1, 3), (1, 9), (2, 1)]


def test_kept_tables_are_read_back_and_cleared(spark):
    df = K.kept(spark.range(5), "t")
    assert df.count() == 5 and "ExistingRDD" not in df._jdf.queryExecution().toString()
    path = K._made[-1][1]
    K.clear()
    import os

    assert not K._made and not os.path.exists(path.removeprefix("file:"))


def test_a_scope_deletes_what_was_kept_in_it(spark):
    from pathlib import Path

    before = K.kept(spark.range(3))
    with K.scope():
        inner = K.kept(spark.range(5))
        rows = inner.count()
        folder = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
    assert rows == 5 and not folder.exists() and before.count() == 3
