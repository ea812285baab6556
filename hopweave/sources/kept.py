"""Tables that a plan uses more than once: written to the folder that driver and executors share, and read back.

They cut the lineage, survive lost executors, and go when the application ends (or with `clear`).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir or checkpoint folder; a local session without either gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hopweave-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions within it delete their shuffle files as they end; else these stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end what was kept within it, so that a long session holds only what it still reads."""
    before = len(_made)
    try:
        yield
    finally:
        clear(before)


def clear(first: int = 0) -> None:
    """Deletes every kept table, or those from `first` on; plans that read one fail afterwards."""
    while len(_made) > first:
        spark, path = _made.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: its folder is cleared by whoever made it
            continue


atexit.register(clear)
