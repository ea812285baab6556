"""Mixing sources to target sizes by weighted sampling without replacement (Efraimidis and Spirakis).

Each source takes whole epochs of all its documents while its target holds them; the rest of the target is filled from its
documents in the order of key = -ln(u) / weight, u from a hash of (seed, doc_id, text size), up to the prefix sum that is nearest to the rest.

Cases: a null source is a source of its own, last in order; null text has size 0; documents of size 0 are taken 0 words; rows
that repeat are documents of their own; an empty table gives an empty result; a source of size 0 has target 0; documents of equal
keys follow each other by doc_id (null first) and size; very long texts are measured whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, words, written

SEED = 20


def text_size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sources: DataFrame, share: float, most: float, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """source, source_size -> also target.

    Sources have the weights by code point order, repeating; target = min(most * size, level * weight) with the one level at
    which the targets add up to share * all sizes: handing on what exceeds a cap again and again ends there. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    full = Window.orderBy("_cap_level", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("_w", w)
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_cap_level", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_rest", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_try", F.col("_rest") / F.col("_open"))
        .withColumn("_level", F.min(F.when(F.col("_try") <= F.col("_cap_level"), F.struct("_cap_level", "_try"))).over(everything)["_try"])
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))))
        .select("source", "source_size", "target")
    )


def mix_sources(docs: DataFrame, weight: Column, size: Column, share: float = 1.5, most: float = 2.0, seed: int = SEED, bucket_rows: int = 4_000) -> DataFrame:
    """One row a document: doc_id, source, size, weight, source_size, target, epochs, selected, taken.

    The prefix sums are taken in two steps, over buckets of the key and within each bucket, so a source of any size is dealt
    over tasks of about bucket_rows rows.
    """
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    slim = docs.select("doc_id", "source", size.alias("size"), weight.cast("double").alias("weight"), u.alias("_u"))
    slim = written(slim.withColumn("key", -F.log("_u") / F.greatest("weight", F.lit(1e-9))).drop("_u"), "mix-sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"), F.avg("weight").alias("_mean"))
    goal = targets(sources.select("source", "source_size"), share, most)
    goal = goal.join(sources.select("source", "_rows", "_mean"), goal["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    goal = (
        goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long"))
        .withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
        .withColumn("_buckets", F.ceil(F.col("_rows") / bucket_rows))
    )
    goal = goal.withColumnRenamed("source", "_source")
    rows = slim.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = written(rows.withColumn("_bucket", F.floor((1 - F.exp(-F.col("key") * F.col("_mean"))) * F.col("_buckets"))), "mix-keys")
    of = [F.coalesce("source", F.lit("")), F.col("source").isNull()]
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*of).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce("_before", F.lit(0)).alias("_before"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))).drop("_source", "_b")
    within = Window.partitionBy(*of, "_bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.col("_before") + F.sum("size").over(within))
    selected = (F.col("_upto") - F.col("size") / 2.0) <= F.col("_rest")
    return rows.withColumn("selected", selected & (F.col("_rest") > 0) & (F.col("epochs") < most)).select(
        "doc_id", "source", "size", "weight", "source_size", "target", "epochs", "selected", ((F.col("epochs") + F.col("selected").cast("long")) * F.col("size")).alias("taken")
    )


def quality_weights(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """docs with _quality, and the weight it means: 2 if labelled good, 0.5 if labelled bad (any label), 1 without a label."""
    q = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    weight = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    return docs.join(q, docs["doc_id"] == F.col("_id"), "left").drop("_id"), weight


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))
    rows, weight = quality_weights(slim, labels)
    return mix_sources(rows, weight, F.col("size"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "selected")


OP8_SQL = """
WITH q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    CASE q.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS weight,
    (('0x' || substr(md5(concat_ws(':', '20', d.doc_id::VARCHAR, md5(md5(coalesce(d.text, ''))))), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0 AS u
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
k AS (SELECT *, -ln(u) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / w AS cap_level,
    (1.5 * sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest / open AS level FROM r WHERE rest / open <= cap_level ORDER BY cap_level, level LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN cap ELSE least(cap, (SELECT level FROM l) * w) END AS target FROM r),
e AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END)::BIGINT AS epochs FROM t),
p AS (SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, greatest(0, e.target - e.epochs * e.source_size) AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + (upto - size / 2.0 <= rest AND rest > 0 AND epochs < 2)::BIGINT) * size)::BIGINT AS taken,
  source, epochs, (upto - size / 2.0 <= rest AND rest > 0 AND epochs < 2) AS selected
FROM p
"""
