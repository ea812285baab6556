"""A partitioner's input written in chunks at known byte offsets, so that a hub's line is many rows, and its owner maps.

The text is a header `N M 100` and, for each node in order, its size and its neighbours counted from 1, divided by spaces. A line is
cut after every `chunk` neighbours; each piece knows its bytes, prefix sums give its offset in the whole text, and files hold runs
of pieces in order: the files, one after the other, are the text.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.operators.sampling import adjacency

from .binary import opened, write_raw

CHUNK, RUN, FILE_BYTES = 4096, 1 << 16, 64 << 20


def line_chunks(edges: DataFrame, nodes: DataFrame, chunk: int = CHUNK, run: int = RUN, keep=None) -> DataFrame:
    """node, part, text, bytes, offset: the pieces of every node's line; node -1 is the header. No row has over `chunk` neighbours."""
    keep = keep or (lambda df: df)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    graph = adjacency(keep(both), keep)
    some = graph.near.groupBy(F.col("dst").alias("node"), F.floor(F.col("pos") / chunk).alias("part"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "src"))), lambda x: F.concat(F.lit(" "), (x["src"] + 1).cast("string")))
    pieces = some.agg(F.array_join(listed, "").alias("near"))
    top = graph.deg.agg(F.max("deg").alias("top"))
    deg = nodes.select("node").join(graph.deg, "node", "left").crossJoin(F.broadcast(top))  # one row
    size = F.coalesce(F.floor(F.lit(10) * F.col("deg") / F.col("top")), F.lit(0)).cast("string")
    last = F.coalesce(F.floor((F.col("deg") - 1) / chunk), F.lit(0))
    lines = deg.select("node", size.alias("size"), last.alias("last"))
    first = pieces.join(lines, "node", "right").select("node", F.coalesce("part", F.lit(0)).alias("part"), "size", "last", F.coalesce("near", F.lit("")).alias("near"))
    head, end = F.when(F.col("part") == 0, F.col("size")).otherwise(""), F.when(F.col("part") == F.col("last"), "\n").otherwise("")
    rows = first.select("node", F.col("part").cast("bigint").alias("part"), F.concat(head, "near", end).alias("text"))
    n, m = nodes.count(), both.where("src < dst").count()
    header = edges.sparkSession.createDataFrame([(-1, 0, f"{n} {m} 100\n")], "node bigint, part bigint, text string")
    rows = keep(rows.unionByName(header).withColumn("bytes", F.octet_length("text").cast("bigint")).withColumn("_c", F.floor(F.col("node") / run)))
    # prefix sums over runs of ids, over a run's nodes, and over a node's pieces
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    by_node = rows.groupBy("_c", "node").agg(F.sum("bytes").alias("n"))
    by_run = by_node.groupBy("_c").agg(F.sum("n").alias("n")).select("_c", F.coalesce(F.sum("n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
    by_node = by_node.select("_c", "node", F.coalesce(F.sum("n").over(upto(["_c"], "node")), F.lit(0)).alias("_b")).join(by_run, "_c").select("node", (F.col("_a") + F.col("_b")).alias("_begin"))
    rows = rows.withColumn("_p", F.coalesce(F.sum("bytes").over(upto(["node"], "part")), F.lit(0))).join(by_node, "node")
    return rows.select("node", "part", "text", "bytes", (F.col("_begin") + F.col("_p")).alias("offset"))


def write_lines(chunks: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """The text of chunks as files of path, named by the order in which they are read; a piece belongs to the file that its first
    byte lies in. A file appears when it is whole, and a task's retry replaces it."""
    opened(path)[0].create_dir(opened(path)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, into = opened(path)
        name, tmp, out, at = None, "", None, None
        for batch in batches:
            for offset, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if offset // file_bytes != name:
                    if out is not None:
                        out.close()
                        fs.move(tmp, posixpath.join(into, f"{name:08d}.txt"))
                    name, tmp, at = offset // file_bytes, posixpath.join(into, f"_{uuid.uuid4().hex}"), offset
                    out = fs.open_output_stream(tmp)
                content = text.encode()
                if offset != at:
                    raise ValueError(f"the piece at {offset} should be at {at}")
                out.write(content)
                at += len(content)
        if out is not None:
            out.close()
            fs.move(tmp, posixpath.join(into, f"{name:08d}.txt"))
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int64())})

    dealt = chunks.select("offset", "text").repartition(F.floor(F.col("offset") / file_bytes)).sortWithinPartitions("offset")
    dealt.mapInArrow(write, "done bigint").write.format("noop").mode("overwrite").save()


def write_owner_map(owners: DataFrame, path: str) -> None:
    """owners (node 0 .. N-1, part) as raw int32 by node, as other programs read a partition map."""
    write_raw(owners, path, "<i4", "node", "part")


def write_owner_lines(owners: DataFrame, path: str, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> None:
    """owners as a partitioner's output: the part of node i in line i."""
    line = F.concat(F.col("part").cast("string"), F.lit("\n"))
    runs = owners.groupBy(F.floor(F.col("node") / chunk).alias("_c")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", line.alias("l")))), lambda x: x["l"]), "").alias("text"))
    runs = runs.withColumn("bytes", F.octet_length("text").cast("bigint"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    at = runs.select("_c", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))  # a row for each 4096 nodes
    write_lines(runs.join(at, "_c").select("offset", "text"), path, file_bytes)
