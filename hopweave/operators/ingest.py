"""Cleaning, splits and offsets of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.functions.portable import draw_key, draw_unit


#: Rows that a task of a step sorts or groups at most, on the average.
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int:
    """As many tasks as keep each at about task_rows rows, however many there are; a task a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // task_rows))


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def simplify(edges: DataFrame) -> DataFrame:
    return edges.distinct()


def symmetrize(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def clean_labels(labels: DataFrame) -> DataFrame:
    """NaN and null become class 0."""
    return labels.withColumn("label", F.coalesce(F.nanvl(F.col("label").cast("double"), F.lit(0.0)), F.lit(0.0)).cast("int"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("deg"))


def random_split(nodes: DataFrame, seed: int = 1, train: float = 0.8, val: float = 0.1) -> DataFrame:
    u = draw_unit(draw_key(seed, "split", F.col("node")))
    return nodes.select("node", F.when(u < train, "train").when(u < train + val, "val").otherwise("test").alias("split"))


def ranked(rows: DataFrame, order: list, name: str, bucket_rows: int = 100_000, key=None) -> DataFrame:
    """rows with a global 0-based rank by (key, *order), taken in two steps: over the buckets of a hex key's first digits (as many
    as make buckets of about bucket_rows rows), and within each, so that no task has to hold all rows."""
    digits, n = 1, rows.count()
    while n > bucket_rows * 16**digits:
        digits += 1
    bucket = F.substring(key, 1, digits)
    tagged = rows.withColumn("_key", key).withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    base = sizes.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", *order))
    return tagged.withColumn("_r", within).join(base, "_bucket").withColumn(name, (F.col("_base") + F.col("_r") - 1).cast("bigint")).drop("_key", "_bucket", "_r", "_base")


def ranked_down(rows: DataFrame, by: list[str], value: str, node: str = "node", chunk: int = 1 << 16) -> DataFrame:
    """rows with _r: 1-based ranks within by, largest value first, then smallest node. Three steps: over the counts of each distinct
    value, over the counts of each run of `chunk` ids within a value, and within each run; so no task gets all rows of a group or
    of a value, nor all runs of a group. Both joins are by shuffle: either side of them may be many rows of the given ones, which
    a plan would else collect in the driver and broadcast."""
    tagged = rows.withColumn("_c", F.floor(F.col(node) / chunk))
    cells = tagged.groupBy(*by, value, "_c").agg(F.count("*").alias("_n"))
    values = cells.groupBy(*by, value).agg(F.sum("_n").alias("_all"))
    larger = Window.partitionBy(*by).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    values = values.select(*by, value, F.coalesce(F.sum("_all").over(larger), F.lit(0)).alias("_above"))  # a row a distinct value
    before = Window.partitionBy(*by, value).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, value, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")).join(values.hint("merge"), [*by, value])
    within = F.row_number().over(Window.partitionBy(*by, value, "_c").orderBy(node))
    return tagged.withColumn("_w", within).join(cells.hint("merge"), [*by, value, "_c"]).withColumn("_r", F.col("_above") + F.col("_base") + F.col("_w")).drop("_c", "_w", "_base", "_above")


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Edges in the order of (src, dst): ranges of the order are dealt over tasks and sorted in each."""
    return edges.orderBy("src", "dst")


def permutation_split(nodes: DataFrame, seed: int = 1, train: float = 0.8) -> DataFrame:
    """The first int(train * N) nodes of a seeded permutation are train, all others val."""
    n = nodes.agg(F.count("*").alias("_all"))
    rows = ranked(nodes, ["node"], "rank", key=draw_key(seed, "permute", F.col("node"))).crossJoin(F.broadcast(n))
    return rows.select("node", F.when(F.col("rank") < F.floor(F.col("_all") * F.lit(train)), "train").otherwise("val").alias("split"))


def csr_offsets(edges: DataFrame, nodes: DataFrame, chunk: int = 4096) -> DataFrame:
    """node, deg, begin: the exclusive prefix sum of in-degrees in node order, over runs of `chunk` ids and within each."""
    deg = nodes.join(in_degrees(edges), "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg"), F.floor(F.col("node") / chunk).alias("_c"))
    runs = deg.groupBy("_c").agg(F.sum("deg").alias("_n"))
    base = runs.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.sum("deg").over(Window.partitionBy("_c").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    return deg.withColumn("_s", within).join(base, "_c").select("node", "deg", (F.col("_base") + F.col("_s") - F.col("deg")).alias("begin"))


def vertex_sizes(edges: DataFrame) -> DataFrame:
    """node, deg, size = int(10 * degree / largest degree)."""
    deg = in_degrees(edges)
    return deg.crossJoin(F.broadcast(deg.agg(F.max("deg").alias("top")))).select("node", "deg", F.floor(F.lit(10) * F.col("deg") / F.col("top")).cast("bigint").alias("size"))


def range_checks(features: DataFrame, labels: DataFrame, owners: DataFrame, dims: int, classes: int, parts: int) -> DataFrame:
    """One row: sums of features, labels and owners, and how many are null, of another length or out of their range. features
    are summed over all numbers; 0 bad ones is what a reader expects."""
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    count_if = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    f = features.agg(F.round(F.sum(total), 4).alias("csum_features"), count_if(F.col("vec").isNull() | (F.size("vec") != dims)).alias("bad_features"))
    c = labels.agg(F.sum("label").cast("bigint").alias("csum_labels"), count_if(F.col("label").isNull() | ~F.col("label").between(0, classes - 1)).alias("bad_labels"))
    o = owners.agg(F.sum("part").cast("bigint").alias("csum_owners"), count_if(F.col("part").isNull() | ~F.col("part").between(0, parts - 1)).alias("bad_owners"))
    return f.crossJoin(c).crossJoin(o)  # three single rows


def checksums(edges: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: counts and sums that a reader can verify."""
    offsets = csr_offsets(edges, nodes)
    e = edges.agg(F.count("*").alias("num_edges"), F.sum("src").alias("csum_edges"))
    n = offsets.agg(F.count("*").alias("num_nodes"), F.sum(F.col("begin")).alias("csum_offsets"))
    c = labels.agg((F.max("label") + 1).cast("bigint").alias("num_classes"), F.sum("label").alias("csum_labels"))
    return e.crossJoin(n).crossJoin(c)
