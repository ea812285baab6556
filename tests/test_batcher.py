"""Exact batches from streams whose files cut the same seeds in different ways."""

import os
from collections import defaultdict

import pandas as pd

from hopweave.streaming import batcher as B


def write(spark, folder, cuts, seeds, stamp=0):
    """seeds (seq, node, ts) as a file for each run that cuts delimit, in order of time."""
    folder.mkdir(exist_ok=True)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(seeds)])):
        frame = pd.DataFrame(seeds[a:b], columns=["seq", "node", "ts"]).astype({"seq": "int64", "node": "Int64"})
        frame["ts"] = pd.to_datetime(frame["ts"], unit="s").astype("datetime64[us]")
        path = folder / f"part-{stamp + k:05d}.parquet"
        frame.to_parquet(path)
        os.utime(path, (1_700_000_000 + stamp + k, 1_700_000_000 + stamp + k))


def run(spark, folder, out, checkpoint, size, lanes, files=1):
    stream = spark.readStream.schema("seq bigint, node bigint, ts timestamp").option("maxFilesPerTrigger", files).parquet(str(folder))
    q = B.started(B.exact_batches(stream, size, lanes), str(out), str(checkpoint))
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    got = defaultdict(list)
    for r in spark.read.schema(B.OUT).parquet(str(out)).collect():
        got[r.lane, r.batch].append((r.rank, r.node, r.last))
    return {k: sorted(v) for k, v in got.items()}


def seeds(n):
    return [(i, (i * 37) % 1009, 1000 + i) for i in range(n)]


def marks(n, lanes=40, at=100_000):
    return [(n + i, None, at + i) for i in range(lanes)]


def test_batches_do_not_depend_on_the_files(spark, tmp_path):
    all_ = seeds(230)
    results = []
    for k, (cuts, files) in enumerate([([230], 1), ([7, 50, 51, 130, 230], 1), ([60, 120, 230], 2)]):
        write(spark, tmp_path / f"in{k}", cuts, all_ + marks(230))
        results.append(run(spark, tmp_path / f"in{k}", tmp_path / f"out{k}", tmp_path / f"cp{k}", 16, 3, files))
    assert results[0] == results[1] == results[2]
    by_lane = defaultdict(list)
    for (lane, batch), rows in sorted(results[0].items()):
        assert [r[0] for r in rows] == list(range(len(rows)))
        last = rows[0][2]
        assert len(rows) == 16 and not last or last and len(rows) <= 16
        by_lane[lane] += [r[1] for r in rows]
        assert batch == len([k for k in results[0] if k[0] == lane and k[1] < batch])
    assert sorted(n for ns in by_lane.values() for n in ns) == sorted(n for _, n, _ in all_)
    order = {n: s for s, n, _ in all_}
    assert all([order[n] for n in ns] == sorted(order[n] for n in ns) for ns in by_lane.values())


def test_left_over_seeds_wait_over_a_restart(spark, tmp_path):
    all_ = seeds(50)
    write(spark, tmp_path / "in", [], all_[:20])
    first = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp", 16, 1)
    assert {k: len(v) for k, v in first.items()} == {(0, 0): 16}  # four wait: no mark has carried time on
    write(spark, tmp_path / "in", [], all_[20:] + marks(50), stamp=10)
    second = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp", 16, 1)
    assert {k: len(v) for k, v in second.items()} == {(0, 0): 16, (0, 1): 16, (0, 2): 16, (0, 3): 2}
    assert [n for k in sorted(second) for _, n, _ in second[k]] == [n for _, n, _ in all_]
    assert {last for _, _, last in second[0, 3]} == {True}


def test_the_sessions_own_store_stays(spark):
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != B.PROVIDER
