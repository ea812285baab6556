"""Mini-batches from a stream of seeds: files arrive, a bounded number is taken at a time, every batch is sampled and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators.sampling import sample_blocks
from hopweave.operators.splitting import split_blocks


def seed_stream(spark: SparkSession, path: str, schema: str, node: str, files_at_once: int = 10) -> DataFrame:
    """node, ts of a stream of Parquet files; files_at_once bounds what waits, as a queue's capacity would."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return rows.select(F.col(node).cast("bigint").alias("node"), F.col("ts"))


def stream_splits(seeds: DataFrame, edges: DataFrame, owners: DataFrame, fanouts: list[int], out: str, checkpoint: str, seed: int = 1):
    """Starts a query that ends when all files are read. Each micro-batch is one batch of seeds; its split counts
    (batch, layer, src_part, dst_part, edges) replace that batch's folder, so a repeated micro-batch changes nothing."""

    def one(rows: DataFrame, batch: int) -> None:
        batches = rows.select(F.lit(batch).cast("bigint").alias("batch"), "node").distinct()
        split = split_blocks(sample_blocks(edges, batches, fanouts, seed), owners)
        split.groupBy("batch", "layer", "src_part", "dst_part").agg(F.count("*").alias("edges")).write.mode("overwrite").parquet(f"{out}/run={batch}")

    return seeds.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_seeds(seeds: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, seeds: seeds by event-time window, late ones dropped after the watermark."""
    return seeds.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("seeds")).select(F.col("window.start").alias("start"), "seeds")
