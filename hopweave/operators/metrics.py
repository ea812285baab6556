"""What a split of sampled blocks costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .owners import with_owners


def input_nodes(blocks: DataFrame, last_layer: int) -> DataFrame:
    """batch, node: distinct sources of the deepest hop."""
    return blocks.where(F.col("layer") == last_layer).select("batch", F.col("src").alias("node")).distinct()


def naive_movement(inputs: DataFrame, owners: DataFrame, parts: int = 4) -> DataFrame:
    """Share of input nodes not owned by the part that the batch is for (batch mod parts)."""
    rows = inputs.join(owners, "node")
    moved = F.sum(F.when(F.col("part") != F.pmod("batch", F.lit(parts)), 1).otherwise(0))
    return rows.agg(F.count("*").alias("inputs"), moved.cast("bigint").alias("moved"), F.round(moved / F.count("*"), 6).alias("ratio"))


def cross_communication(split: DataFrame, last_layer: int) -> DataFrame:
    """Cut edges among sampled ones, and distinct destinations of cut edges by (batch, part, hop), over all inputs (distinct
    sources of the last hop). split has src_part and dst_part; it is read once, as both distinct counts are of one expansion."""
    cut = F.col("src_part") != F.col("dst_part")
    last = F.col("layer") == last_layer
    facts = F.array(
        F.struct(F.lit("cut").alias("kind"), F.col("batch"), F.col("layer"), F.col("src_part").alias("part"), F.when(cut, F.col("dst")).alias("node"), cut.cast("bigint").alias("n")),
        F.struct(F.lit("input").alias("kind"), F.col("batch"), F.lit(last_layer).alias("layer"), F.lit(-1).alias("part"), F.when(last, F.col("src")).alias("node"), F.lit(0).cast("bigint").alias("n")),
    )
    rows = split.select(F.explode(facts).alias("f")).select("f.*").where("node is not null")
    per = rows.groupBy("kind", "batch", "layer", "part", "node").agg(F.sum("n").alias("n"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cut_edges"), F.count(F.when(F.col("kind") == "cut", 1)).alias("cut_nodes"), F.count(F.when(F.col("kind") == "input", 1)).alias("inputs"))
    return one.withColumn("edge_ratio", F.round(F.col("cut_edges") / F.col("inputs"), 6)).withColumn("node_ratio", F.round(F.col("cut_nodes") / F.col("inputs"), 6))


def redundancy(blocks: DataFrame, parts: int = 4) -> DataFrame:
    """Nodes that two parts' batches both compute, over all nodes computed, hops from 1.

    A node of k parts is common to k (k - 1) / 2 pairs of them, so pairs are counted, not joined.
    """
    own = blocks.where("layer >= 1").select(F.pmod("batch", F.lit(parts)).alias("part"), "layer", F.col("dst").alias("node")).distinct()
    per = own.groupBy("layer", "node").agg(F.count("*").alias("k"))
    return per.agg(F.sum(F.floor(F.col("k") * (F.col("k") - 1) / 2)).cast("bigint").alias("common"), F.sum("k").alias("computed")).withColumn("ratio", F.round(F.col("common") / F.col("computed"), 6))


def pair_redundancy(blocks: DataFrame, parts: int = 4) -> DataFrame:
    """layer, a, b, common: the same by pairs of parts a < b."""
    own = blocks.where("layer >= 1").select(F.pmod("batch", F.lit(parts)).alias("part"), "layer", F.col("dst").alias("node")).distinct()
    a, b = own.select("layer", "node", F.col("part").alias("a")), own.select("layer", "node", F.col("part").alias("b"))
    return a.join(b, ["layer", "node"]).where("a < b").groupBy("layer", "a", "b").agg(F.count("*").alias("common"))


def work_skew(split: DataFrame) -> DataFrame:
    """(most - least) / least edges of a part."""
    per = split.groupBy("part").agg(F.count("*").alias("n"))
    return per.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.round((F.max("n") - F.min("n")) / F.min("n"), 6).alias("skew"))


def shuffle_ratio(owned: DataFrame, shuffled: DataFrame) -> DataFrame:
    """layer, owned, shuffled, ratio."""
    a = owned.groupBy("layer").agg(F.count("*").alias("owned"))
    b = shuffled.groupBy("layer").agg(F.count("*").alias("shuffled"))
    return a.join(b, "layer", "left").select("layer", "owned", F.coalesce("shuffled", F.lit(0)).alias("shuffled"), F.round(F.coalesce("shuffled", F.lit(0)) / F.col("owned"), 6).alias("ratio"))


def epoch_means(rows: DataFrame, value: str) -> DataFrame:
    """Mean of value over all epochs but the first."""
    return rows.where("epoch > 0").agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("epochs"))


def run_lengths(values: DataFrame) -> DataFrame:
    """value, n of a sorted column's runs."""
    return values.groupBy("value").agg(F.count("*").alias("n"))


def changes(values: DataFrame) -> DataFrame:
    """values (grp, pos, value) where the value differs from the one before it in its group."""
    before = F.lag("value").over(Window.partitionBy("grp").orderBy("pos"))
    return values.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("value"))).drop("_b")
