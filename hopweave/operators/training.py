"""A training loop whose state is a small table a step, so that it goes on from the last step that was written whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layers import cross_entropy, cross_entropy_gradient, linear

GROUPS = 64


def summed_gradient(x: DataFrame, grad: DataFrame, rows: int, columns: int, groups: int = GROUPS) -> DataFrame:
    """i, k, value of X^T G. Each task adds up its own nodes, `groups` reducers what the tasks have, and one what those have."""
    both = x.join(grad.select("node", F.col("vec").alias("_g")), "node").withColumn("_t", F.pmod(F.spark_partition_id(), F.lit(groups)))
    names = [f"g{i}_{k}" for i in range(rows) for k in range(columns)]
    sums = both.groupBy("_t").agg(*[F.sum(F.col("vec")[i] * F.col("_g")[k]).alias(f"g{i}_{k}") for i in range(rows) for k in range(columns)])
    sums = sums.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"g{i}_{k}").alias("value")) for i in range(rows) for k in range(columns)])
    return sums.select(F.explode(cells).alias("c")).select("c.i", "c.k", "c.value")


def written_steps(spark: SparkSession, path: str) -> list[int]:
    """The steps under path that were written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("step=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("step=")) for n in done)


def state_at(spark: SparkSession, path: str, step: int) -> DataFrame:
    """i, k, value, m, v, loss: weights, Adam's two moments, and (at i = k = 0, after step 0) the mean loss before this step's move."""
    return spark.read.parquet(f"{path}/step={step:08d}")


def train(x: DataFrame, labels: DataFrame, w: list[list[float]], classes: int, path: str, steps: int, rate: float = 0.05) -> DataFrame:
    """The state after `steps` steps of Adam on a linear layer under cross entropy, as state_at returns it.

    Step t's table is written once and whole (Spark's commit); a run that finds steps under path goes on from the last of them and
    gives the same weights as one that was never stopped. w, the weights of step 0, is ignored then. Weights belong to the plan of
    each step, so they are read as rows x classes numbers.
    """
    spark, rows = x.sparkSession, len(w)
    done = written_steps(spark, path)
    if not done:
        cells = [(i, k, float(v), 0.0, 0.0, None) for i, row in enumerate(w) for k, v in enumerate(row)]
        first = spark.createDataFrame(cells, "i int, k int, value double, m double, v double, loss double")
        first.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={0:08d}")
        done = [0]
    for t in range(done[-1] + 1, steps + 1):
        state = state_at(spark, path, t - 1)
        now = [[0.0] * classes for _ in range(rows)]
        for r in state.select("i", "k", "value").collect():  # rows x classes numbers
            now[r["i"]][r["k"]] = r["value"]
        logits = linear(x, now)
        gradient = summed_gradient(x, cross_entropy_gradient(logits, labels, classes).select("node", "vec"), rows, classes).withColumnRenamed("value", "g")
        loss = cross_entropy(logits, labels, classes).agg(F.avg("loss").alias("_loss"))
        moved = state.drop("loss").join(gradient, ["i", "k"]).crossJoin(F.broadcast(loss))  # one row
        moved = moved.withColumn("m", 0.9 * F.col("m") + 0.1 * F.col("g")).withColumn("v", 0.999 * F.col("v") + 0.001 * F.col("g") * F.col("g"))
        step = F.lit(rate) * (F.col("m") / (1 - 0.9**t)) / (F.sqrt(F.col("v") / (1 - 0.999**t)) + 1e-8)
        after = moved.select("i", "k", (F.col("value") - step).alias("value"), "m", "v", F.when((F.col("i") == 0) & (F.col("k") == 0), F.col("_loss")).alias("loss"))
        after.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={t:08d}")
    return state_at(spark, path, steps)


def losses_of(spark: SparkSession, path: str) -> DataFrame:
    """step, loss: the mean loss that each written step began with."""
    whole = spark.read.option("basePath", path).parquet(f"{path}/step=*")
    return whole.where("loss is not null").select(F.col("step").cast("int").alias("step"), "loss")
