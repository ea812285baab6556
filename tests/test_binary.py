"""Raw arrays by byte ranges, and graphs as folders of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.operators import ingest as I
from hopweave.operators import owners as O
from hopweave.plans import queries
from hopweave.sources import binary as R
from hopweave.sources.graphs import Graph


def test_ranges_cover_a_file_once(spark, tmp_path):
    values = np.arange(10_000, dtype="<i8") * 3 - 7
    (tmp_path / "a.bin").write_bytes(values.tobytes())
    df = R.read_raw(spark, str(tmp_path / "a.bin"), range_bytes=1600)
    assert df.rdd.getNumPartitions() == 50
    assert [(r.pos, r.value) for r in df.orderBy("pos").collect()] == list(enumerate(values.tolist()))


def test_a_file_of_over_two_gigabytes_is_many_tasks(spark, tmp_path):
    """A sparse file of 2.2 GB: its ranges are planned from its size, and those at both ends are read."""
    n = 2_200_000_000 // 8
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(n * 8)
        f.seek((n - 1) * 8)
        f.write(np.array([41], "<i8").tobytes())
    reader = R.RawArrayReader({"path": str(tmp_path / "big.bin")}, ["pos", "value"])
    parts = reader.partitions()
    assert len(parts) == 33 and sum(p.length for p in parts) == n * 8 and max(p.length for p in parts) == R.RANGE_BYTES
    last = list(reader.read(parts[-1]))
    assert last[-1].column(0)[-1].as_py() == n - 1 and last[-1].column(1)[-1].as_py() == 41
    assert max(b.nbytes for b in last) <= 4 * R.BATCH_BYTES


@pytest.mark.parametrize("dtype,width", [("<i4", 1), ("<f4", 3), (">f8", 2), ("<i8", 1)])
def test_types_and_folders_of_files(spark, tmp_path, dtype, width):
    values = np.arange(60).reshape(-1, width).astype(dtype)
    for k, part in enumerate(np.array_split(values, 3)):
        (tmp_path / f"{k}.bin").write_bytes(part.tobytes())
    (tmp_path / "_left").write_bytes(b"x")
    rows = R.read_raw(spark, str(tmp_path), dtype, width, range_bytes=20).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(60 // width))
    assert np.array_equal(np.array([r.value for r in rows]).reshape(-1, width), values)


def test_columns_that_are_not_named_are_not_made(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.arange(9, dtype="<i8").tobytes())
    assert R.read_raw(spark, str(tmp_path / "a.bin"), columns="value").columns == ["value"]
    reader = R.RawArrayReader({"path": str(tmp_path / "a.bin")}, ["value"])
    assert next(reader.read(reader.partitions()[0])).num_columns == 1
    with pytest.raises(Exception, match="columns are pos and value"):
        R.read_raw(spark, str(tmp_path / "a.bin"), columns="other").count()


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole number of rows"):
        R.read_raw(spark, str(tmp_path / "a.bin")).count()
    with pytest.raises(Exception, match="nowhere"):
        R.read_raw(spark, str(tmp_path / "nowhere.bin")).count()
    (tmp_path / "empty.bin").write_bytes(b"")
    assert R.read_raw(spark, str(tmp_path / "empty.bin")).count() == 0


def test_written_arrays_need_every_position(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 2) for i in range(100)], "pos long, value long")
    R.write_raw(rows.repartition(7), f"{tmp_path}/a", "<i8", file_rows=30)
    assert [p.name for p in sorted((tmp_path / "a").iterdir())] == [f"{i:08d}.bin" for i in range(4)]
    R.write_raw(rows.repartition(3), f"{tmp_path}/a", "<i8", file_rows=30)  # again: the same files
    assert np.array_equal(np.concatenate([np.fromfile(p, "<i8") for p in sorted((tmp_path / "a").iterdir())]), np.arange(100) * 2)
    with pytest.raises(ValueError, match="positions"):
        R.write_raw(rows.where("pos <> 40"), f"{tmp_path}/b", "<i8")
    with pytest.raises(Exception, match="not whole"):
        R.write_raw(rows.where("pos <> 40").unionByName(rows.where("pos = 41")), f"{tmp_path}/c", "<i8")


def graph(spark, sf) -> Graph:
    """The purchase graph with nodes counted from 0."""
    g = queries.load(spark, sf)
    low = g.nodes.agg(F.min("node")).first()[0]
    shift = lambda df, *c: df.select(*[(F.col(x) - low).alias(x) if x in c else F.col(x) for x in df.columns])
    return Graph(shift(g.edges, "src", "dst"), shift(g.nodes, "node"), shift(g.features, "node"), shift(g.labels, "node"), shift(O.modulo(g.nodes), "node"), g.dims)


def same(a, b) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_round_trip_of_a_graph(spark, sf, tmp_path):
    g = graph(spark, sf)
    splits = I.permutation_split(g.nodes)
    R.write_folder(g, f"{tmp_path}/g", splits)
    back = R.read_folder(spark, f"{tmp_path}/g", range_bytes=4096)
    assert same(back.edges.select("src", "dst"), g.edges.select("src", "dst"))
    assert same(back.owners, g.owners) and same(back.labels.select("node", "label"), g.labels)
    assert {r.node: r.split for r in back.labels.collect()} == {r.node: r.split for r in splits.collect()}
    assert same(back.features, g.features.select("node", F.col("vec").cast("array<float>").cast("array<double>").alias("vec")))
    n = g.nodes.count()
    ends = np.concatenate([np.fromfile(p, "<i8") for p in sorted((tmp_path / "g" / "indptr.bin").iterdir())])
    assert len(ends) == n + 1 and ends[0] == 0 and ends[-1] == g.edges.count() and (np.diff(ends) >= 0).all()


def test_one_file_a_column_and_wrong_sums(spark, tmp_path):
    """A folder as other programs write it: T-csr with an isolated node; sums that do not agree are an error."""
    arrays = {"indptr": [0, 2, 3, 3, 6], "indices": [1, 2, 0, 0, 1, 2], "labels": [1, 0, 2, 1], "partition_map_opt": [0, 1, 2, 3]}
    for name, values in arrays.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(values, R.FILES[name]).tobytes())
    x = np.arange(8, dtype="<f4").reshape(4, 2)
    (tmp_path / "features.bin").write_bytes(x.tobytes())
    meta = {"num_nodes": 4, "num_edges": 6, "feature_dim": 2, "csum_features": 28, "csum_labels": 4, "csum_offsets": 14, "csum_edges": 6, "num_classes": 3}
    write = lambda m: (tmp_path / "meta.txt").write_text("".join(f"{k}={v}\n" for k, v in m.items()))
    write(meta)
    g = R.read_folder(spark, str(tmp_path))
    assert sorted((r.dst, r.src) for r in g.edges.collect()) == [(0, 1), (0, 2), (1, 0), (3, 0), (3, 1), (3, 2)]
    assert {r.node: r.vec for r in g.features.collect()} == {i: x[i].tolist() for i in range(4)}
    assert {r.node: r.part for r in g.owners.collect()} == {i: i for i in range(4)}
    for key in ("csum_offsets", "csum_edges", "csum_labels", "num_edges"):
        write({**meta, key: meta[key] + 1})
        with pytest.raises(ValueError, match=key):
            R.read_folder(spark, str(tmp_path))
    write({**meta, "csum_features": 500})
    with pytest.raises(ValueError, match="csum_features"):
        R.read_folder(spark, str(tmp_path))
    write(meta)
