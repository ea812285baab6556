"""Folders of raw arrays (one file a column of a graph) as a Spark data source, and graphs read from and written to them.

    indptr.bin int64 N+1, indices.bin int64 E, features.bin float32 N x F by rows, labels.bin int32 N,
    train_idx.bin and val_idx.bin int64, partition_map_opt.bin int32 N, meta.txt lines key=value

The source cuts a file into byte ranges of whole rows, a task each, and reads them with positions; so a file of any size is many
tasks and none holds more than one piece of it. Files are opened through pyarrow's filesystems (local paths, file, hdfs, s3, gs).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .graphs import Graph, read_meta

#: The files of a folder and their types.
FILES = {"indptr": "<i8", "indices": "<i8", "features": "<f4", "labels": "<i4", "train_idx": "<i8", "val_idx": "<i8", "partition_map_opt": "<i4"}
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def files_at(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in the order of their names but hidden ones."""
    fs, path = opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    inside = fs.get_file_info(pafs.FileSelector(path))
    return sorted((i.path, i.size) for i in inside if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))


@dataclass
class ByteRange(InputPartition):
    path: str
    offset: int
    length: int
    first: int  # position of its first row


class RawArrayReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.uri, self.columns = options["path"], columns
        self.dtype, self.width = np.dtype(options.get("dtype", "<i8")), int(options.get("width", "1"))
        self.row = self.dtype.itemsize * self.width
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        out, first, each = [], 0, max(1, self.range_bytes // self.row) * self.row
        for path, size in files_at(self.uri):
            if size % self.row:
                raise ValueError(f"{path}: {size} bytes are no whole number of rows of {self.row}")
            out += [ByteRange(path, a, min(each, size - a), first + a // self.row) for a in range(0, size, each)]
            first += size // self.row
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        each = max(1, BATCH_BYTES // self.row) * self.row
        if not part.length:
            return
        with opened(self.uri)[0].open_input_file(part.path) as f:
            for a in range(0, part.length, each):
                content = f.read_at(min(each, part.length - a), part.offset + a)
                values, rows = np.frombuffer(content, self.dtype).astype(self.dtype.newbyteorder("=")), len(content) // self.row
                made = []
                for name in self.columns:
                    if name == "pos":
                        made.append(pa.array(np.arange(rows) + part.first + a // self.row))
                    elif self.width == 1:
                        made.append(pa.array(values))
                    else:
                        made.append(pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * self.width), pa.array(values)))
                yield pa.RecordBatch.from_arrays(made, names=self.columns)


class RawArrays(DataSource):
    """pos and value of raw arrays. Options: dtype (as NumPy's), width (numbers a row; over 1 they are an array), rangeBytes, and
    columns (pos,value or one of them): only what it names is made and sent to Spark."""

    @classmethod
    def name(cls) -> str:
        return "raw_arrays"

    def columns(self) -> list[str]:
        wanted = [c.strip() for c in self.options.get("columns", "pos,value").split(",")]
        if not wanted or set(wanted) - {"pos", "value"}:
            raise ValueError(f"columns are pos and value, not {wanted}")
        return wanted

    def schema(self) -> str:
        kinds = {"i8": "bigint", "i4": "int", "f4": "float", "f8": "double"}
        kind = kinds[np.dtype(self.options.get("dtype", "<i8")).str[1:]]
        value = kind if int(self.options.get("width", "1")) == 1 else f"array<{kind}>"
        return ", ".join(f"{c} {'bigint' if c == 'pos' else value}" for c in self.columns())

    def reader(self, schema) -> RawArrayReader:
        return RawArrayReader(dict(self.options), self.columns())


def read_raw(spark: SparkSession, path: str, dtype: str = "<i8", width: int = 1, columns: str = "pos,value", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """pos, value of a raw array's file or of a folder of them, whose positions run on in the order of their names."""
    spark.dataSource.register(RawArrays)
    return spark.read.format("raw_arrays").option("dtype", dtype).option("width", width).option("columns", columns).option("rangeBytes", range_bytes).load(path)


def write_raw(rows: DataFrame, path: str, dtype: str, position: str = "pos", value: str = "value", file_rows: int = 4_000_000) -> None:
    """value (a number, or an array of numbers) in the order of position, as raw files of a folder; positions are 0, 1, ...

    Each run of file_rows positions is one task's file, written under another name and moved when it is whole: a task's retry
    replaces it. A position that is missing or repeated is an error.
    """
    fs, base = opened(path)
    fs.create_dir(base, recursive=True)
    numbers = np.dtype(dtype)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, into = opened(path)
        out, name, tmp, at = None, "", "", 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(tmp, posixpath.join(into, name))

        for batch in batches:
            pos, value_ = batch.column(0).to_numpy(), batch.column(1)
            is_list = pa.types.is_list(value_.type)
            a = 0
            while a < len(pos):
                run = int(pos[a]) // file_rows
                if f"{run:08d}.bin" != name:
                    close()
                    name, tmp, at = f"{run:08d}.bin", posixpath.join(into, f"_{uuid.uuid4().hex}"), run * file_rows
                    out = store.open_output_stream(tmp)
                b = a + int(np.searchsorted(pos[a:], (run + 1) * file_rows))
                if not np.array_equal(pos[a:b], np.arange(at, at + b - a)):
                    raise ValueError(f"positions from {at} on are not whole")
                part = value_.slice(a, b - a)
                flat = (part.flatten() if is_list else part).to_numpy(zero_copy_only=False)
                out.write(flat.astype(numbers).tobytes())
                at, a = at + b - a, b
        close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int64())})

    chosen = rows.select(F.col(position).cast("bigint").alias("pos"), F.col(value).alias("value"))
    n, most = chosen.agg(F.count("*"), F.max("pos")).first()
    if n and n != most + 1:
        raise ValueError(f"{n} rows have positions up to {most}")
    dealt = chosen.repartition(max(1, -(-n // file_rows)), F.floor(F.col("pos") / file_rows)).sortWithinPartitions("pos")
    dealt.mapInArrow(write, "done bigint").write.format("noop").mode("overwrite").save()


def compressed(edges: DataFrame, nodes: DataFrame, chunk: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(indptr, indices) as (pos, value) of edges between nodes 0 .. N-1: node i's sources, in the order of their ids, are
    indices[indptr[i] : indptr[i + 1]]. Prefix sums are taken over runs of ids and within each."""
    from hopweave.operators.sampling import adjacency

    graph = adjacency(edges)
    deg = nodes.select("node").join(graph.deg, "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg"), F.floor(F.col("node") / chunk).alias("_c"))
    runs = deg.groupBy("_c").agg(F.sum("deg").alias("_n"))
    base = runs.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.sum("deg").over(Window.partitionBy("_c").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    ends = deg.withColumn("_s", within).join(base, "_c").select("node", "deg", (F.col("_base") + F.col("_s")).alias("end"))
    first = edges.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("value"))
    indptr = ends.select((F.col("node") + 1).alias("pos"), F.col("end").alias("value")).unionByName(first)
    begin = ends.select(F.col("node").alias("dst"), (F.col("end") - F.col("deg")).alias("_b"))
    indices = graph.near.join(begin, "dst").select((F.col("_b") + F.col("pos")).alias("pos"), F.col("src").alias("value"))
    return indptr, indices


def write_folder(g: Graph, path: str, splits: DataFrame | None = None) -> None:
    """A graph whose nodes are 0 .. N-1 as a folder of raw arrays (a file or a folder of part files a column) and meta.txt."""
    from .kept import kept

    indptr, indices = (kept(df, "raw") for df in compressed(g.edges, g.nodes))
    columns = {
        "indptr": indptr,
        "indices": indices,
        "features": g.features.select(F.col("node").alias("pos"), F.col("vec").alias("value")),
        "labels": g.labels.select(F.col("node").alias("pos"), F.col("label").alias("value")),
        "partition_map_opt": g.owners.select(F.col("node").alias("pos"), F.col("part").alias("value")),
    }
    if splits is not None:
        for name, kind in (("train_idx", "train"), ("val_idx", "val")):
            order = F.row_number().over(Window.partitionBy(F.floor(F.col("node") / (1 << 16))).orderBy("node"))
            some = splits.where(F.col("split") == kind).select("node", F.floor(F.col("node") / (1 << 16)).alias("_c"), order.alias("_r"))
            runs = some.groupBy("_c").agg(F.count("*").alias("_n"))
            base = runs.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
            columns[name] = some.join(base, "_c").select((F.col("_base") + F.col("_r") - 1).alias("pos"), F.col("node").alias("value"))
    for name, rows in columns.items():
        write_raw(rows, f"{path}/{name}.bin", FILES[name])
    total = lambda df: df.agg(F.coalesce(F.sum("value"), F.lit(0))).first()[0]
    numbers = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    values = {
        "num_nodes": g.nodes.count(),
        "num_edges": indices.count(),
        "feature_dim": g.dims,
        "csum_features": int(columns["features"].agg(F.coalesce(F.sum(numbers), F.lit(0.0))).first()[0]),
        "csum_labels": total(columns["labels"]),
        "csum_offsets": total(indptr),
        "csum_edges": total(indices),
        "num_classes": (columns["labels"].agg(F.max("value")).first()[0] or -1) + 1,
    }
    fs, base_path = opened(path)
    with fs.open_output_stream(f"{base_path}/meta.txt") as out:
        out.write("".join(f"{k}={v}\n" for k, v in values.items()).encode())


def read_folder(spark: SparkSession, path: str, check: bool = True, range_bytes: int = RANGE_BYTES) -> Graph:
    """A graph from a folder of raw arrays; labels also have split (train, val, test or null) if index files are there. With check
    the sums and counts of meta.txt are compared (features within 100, as single precision adds up) and a mismatch is an error."""
    meta = {r["key"]: r["value"] for r in read_meta(spark, f"{path}/meta.txt").collect()}  # some ten lines
    dims = meta["feature_dim"]
    raw = lambda name, width=1: read_raw(spark, f"{path}/{name}.bin", FILES[name], width, range_bytes=range_bytes)
    fs, base = opened(path)
    there = {n for n in FILES if fs.get_file_info(f"{base}/{n}.bin").type != pafs.FileType.NotFound}
    ends = raw("indptr")
    # the range of each node's sources, cut where a range is long, so that no row stands for a whole hub
    next_ = ends.select((F.col("pos") - 1).alias("dst"), F.col("value").alias("b"))
    rows = ends.select(F.col("pos").alias("dst"), F.col("value").alias("a")).join(next_, "dst").where("b > a")
    runs = rows.select("dst", "b", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.lit(1 << 16).cast("bigint"))).alias("a"))
    at = runs.select("dst", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + (1 << 16), "b") - 1)).alias("pos"))
    edges = at.join(raw("indices"), "pos").select(F.col("value").alias("src"), "dst")
    features = raw("features", dims).select(F.col("pos").alias("node"), (F.col("value") if dims > 1 else F.array("value")).cast("array<double>").alias("vec"))
    labels = raw("labels").select(F.col("pos").alias("node"), F.col("value").alias("label"))
    if {"train_idx", "val_idx"} <= there:
        marks = [read_raw(spark, f"{path}/{n}_idx.bin", FILES[f"{n}_idx"], columns="value").select(F.col("value").alias("node"), F.lit(n).alias("split")) for n in ("train", "val")]
        labels = labels.join(marks[0].unionByName(marks[1]), "node", "left")
    owners = raw("partition_map_opt").select(F.col("pos").alias("node"), F.col("value").alias("part")) if "partition_map_opt" in there else None
    nodes = spark.range(meta["num_nodes"]).select(F.col("id").alias("node"))
    g = Graph(edges, nodes, features, labels, owners if owners is not None else nodes.select("node", F.lit(0).alias("part")), dims)
    if check:
        verify(g, ends, meta)
    return g


def verify(g: Graph, indptr: DataFrame, meta: dict[str, int]) -> None:
    numbers = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    e = g.edges.agg(F.count("*"), F.coalesce(F.sum("src"), F.lit(0))).first()
    f = g.features.agg(F.count("*"), F.coalesce(F.sum(numbers), F.lit(0.0))).first()
    c = g.labels.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    found = {"num_edges": e[0], "csum_edges": e[1], "num_nodes": f[0], "csum_labels": c[1], "csum_offsets": indptr.agg(F.sum("value")).first()[0], "num_nodes of labels": c[0]}
    wanted = {**meta, "num_nodes of labels": meta["num_nodes"]}
    wrong = {k: (v, wanted[k]) for k, v in found.items() if k in wanted and wanted[k] is not None and v != wanted[k]}
    if "csum_features" in meta and meta["csum_features"] is not None and abs(f[1] - meta["csum_features"]) > 100:
        wrong["csum_features"] = (f[1], meta["csum_features"])
    if wrong:
        raise ValueError(f"the folder does not hold what its meta.txt says: {wrong}")
