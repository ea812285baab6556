"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import posixpath
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.sources.kept import shuffles_freed

#: `[^\x20\x09-\x0D]+`
SPACES = "[\\x20\\x09-\\x0D]+"
#: The complement of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for lower-cased text.
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of whole texts that go to Python at once.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of BATCH_ROWS rows at most in its session: Spark's 10,000 rows of long texts are hundreds of MB a task."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: the session's spark.checkpoint.dir or its checkpoint folder.

    A local session without either gets one of its own (tests); a cluster without either is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hopweave-"))
        where = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(where.rstrip("/"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_recorded: list[str] | None = None


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Adds to paths the tables that `written` makes meanwhile."""
    global _recorded
    before, _recorded = _recorded, paths
    try:
        yield
    finally:
        _recorded = before


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a Parquet table in the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    if _recorded is not None:
        _recorded.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns, written; the tables that make has written on the way go."""
    made: list[str] = []
    with recorded(made):
        out = make()
    out = written(out, name)
    remove(out.sparkSession, made)
    return out


def sized_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column, gaps: str = SPACES) -> Column:
    """The words between gaps; null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), gaps), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def fold_of(c: Column, n: int) -> Column:
    """crc32 of an id's decimal text, mod n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def fold(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def columns(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def unused(df: DataFrame, name: str) -> str:
    """A name for a column that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def hand_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, and what they keep adds to the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(task):
    """task (for mapInArrow or mapInPandas), handing memory back when it ends."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        hand_back()

    return run


# --- files on any store that pyarrow knows (file, hdfs, s3, gs), written by tasks


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Committed:
    """A binary file that appears under its name only when closed without an error, so a task's retry replaces and never mixes."""

    def __init__(self, uri: str):
        self.fs, self.path = store(uri)
        self.tmp = posixpath.join(posixpath.dirname(self.path), f"_{uuid.uuid4().hex}.part")

    def __enter__(self):
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.tmp)
        return self.out

    def __exit__(self, kind, *rest):
        self.out.close()
        if kind is None:
            self.fs.move(self.tmp, self.path)
        else:
            self.fs.delete_file(self.tmp)


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = store(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


# --- texts as bytes: numpy over a bounded piece of an Arrow column


def pieces(batch: pa.RecordBatch, column: str, most: int = 250_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes of text; a longer text is a run of its own. Null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    n = len(col)
    if n == 0:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    _, off, data = col.buffers()
    starts = np.frombuffer(off, kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)[:-1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    ends = np.cumsum(lengths)
    while a < n:
        base = ends[a] - lengths[a]
        b = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        b = min(b, n)
        offs = np.concatenate([[0], ends[a:b] - base])
        if starts[b - 1] + lengths[b - 1] - starts[a] == offs[-1]:
            piece = raw[starts[a] : starts[a] + offs[-1]]
        else:
            piece = np.concatenate([raw[starts[i] : starts[i] + lengths[i]] for i in range(a, b)])
        yield a, b, piece, offs
        a = b


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
IN_ALNUM = np.zeros(256, bool)
IN_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of the rows that offs delimits; a word never runs over the end of a row."""
    w = inside[data]
    if not w.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    before, after = np.empty_like(w), np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    before[full] = False
    after[offs[1:][offs[1:] > offs[:-1]] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


LONG_WORD = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever a word stands.

    Eight bytes at a time go through a mixing that is not linear in them, so no family of words collides by construction; words
    of over LONG_WORD bytes go through BLAKE2.
    """
    import hashlib

    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the bytes from each place on
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) + _GOLDEN)
    open_ = np.flatnonzero(lengths <= LONG_WORD)
    at, left = starts[open_], lengths[open_]
    while len(open_):
        h[open_] = mix((h[open_] ^ (eight[at] & _KEEP[np.minimum(left, 8)])) * _GOLDEN + _GOLDEN)
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
