"""Results of runs, published so that a retry changes nothing.

A run's rows go to a folder of its own under a new name; they count when a manifest names that folder. Manifests are numbered and
never overwritten: whoever publishes writes the next number, by a rename that fails if it is taken, and tries again on the new
state. So readers see whole runs only, a run published again replaces itself, and two who publish at once both end up in it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(number, run -> folder) of the newest manifest; (0, {}) without one."""
    fs, root = _fs(spark, f"{path}/manifests")
    if not fs.exists(root):
        return 0, {}
    numbers = [int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(root) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("_")]
    if not numbers:
        return 0, {}
    text = "".join(r["value"] for r in spark.read.text(f"{path}/manifests/{max(numbers):012d}.json").collect())  # a line
    return max(numbers), json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, runs: dict[str, str]) -> bool:
    """Whether this has become manifest `number`."""
    jvm = spark._jvm
    fs, target = _fs(spark, f"{path}/manifests/{number:012d}.json")
    fs.mkdirs(target.getParent())
    _, tmp = _fs(spark, f"{path}/manifests/_{uuid.uuid4().hex}.json")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(runs, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(target), none)
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(tmp, False)
        return False


def publish(rows: DataFrame, path: str, run: str, tries: int = 50) -> int:
    """Publishes rows as this run's; returns the manifest's number. Rows are pipe-delimited text with a header a file."""
    spark, folder = rows.sparkSession, f"runs/{run}-{uuid.uuid4().hex}"
    rows.write.option("sep", "|").option("header", True).csv(f"{path}/{folder}")
    for _ in range(tries):
        number, runs = manifest(spark, path)
        if _commit(spark, path, number + 1, {**runs, run: folder}):
            return number + 1
    raise RuntimeError(f"{run} could not be published in {tries} tries")


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """run and the columns of the schema of every published run."""
    from pyspark.sql import functions as F

    _, runs = manifest(spark, path)
    out = spark.createDataFrame([], f"run string, {schema}")
    for run, folder in sorted(runs.items()):
        out = out.unionByName(spark.read.schema(schema).option("sep", "|").option("header", True).csv(f"{path}/{folder}").select(F.lit(run).alias("run"), "*"))
    return out


def sweep(spark: SparkSession, path: str) -> int:
    """Deletes folders of runs that the newest manifest does not name; for times when nobody publishes."""
    fs, root = _fs(spark, f"{path}/runs")
    named = {f.removeprefix("runs/") for f in manifest(spark, path)[1].values()}
    gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in named]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
