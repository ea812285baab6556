"""Quality rules with risk-controlled cutoffs, in DataFrame operations alone.

Texts get counts (words, symbols, repeated lines, words in repeated 3-word windows) and four ratios of them. A document is
rejected if a ratio exceeds its stratum's cutoff. Cutoffs come from labelled documents: for each stratum and ratio a fixed grid
is tested from its loosest to its strictest cutoff. A cutoff passes if the exact binomial test rejects, at level
delta / (strata * ratios), that it would reject more than `risk` of the good documents: P[Binomial(n good, risk) <= good ones
rejected] <= level. The test stops at the first cutoff that fails (fixed-sequence testing needs no correction within a grid;
Bonferroni's corrects over strata and ratios), so with probability 1 - delta no stratum loses more than its risk * ratios of its
good documents to these rules. Of the passing cutoffs the loosest is used that rejects as many bad documents as any.

A stratum with too few good labels to prove `risk`, even with none of them rejected, is tested at the first of `wider` that they
can prove. The number of good labels alone decides, before any document's ratios are seen, so the test stays exact; cutoffs()
tells each one's risk. A stratum with too few labels for all of them has no cutoff and rejects nothing.

Cases: null text counts as empty; a null stratum is a stratum of its own; rows that repeat are counted each; labels with null
quality or doc_id are ignored, and of several labels of a document the worst holds; without labels only the base rule rejects.
Copies with labels of their own count as labels of their own: the guarantee is about documents as they come, copies included. Of
cutoffs that reject as many bad documents the loosest is taken; very long texts are counted whole; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, load, sized_broadcast, words, written

#: Ratios and their cutoffs, loosest first. They are fixed ahead, as the test asks for.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3),
    "word_length": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0),
}
RISK, DELTA = 0.005, 0.05
#: Limits for strata whose labels cannot prove RISK: with 4 strata they take 286 and 113 good labels, RISK takes 1151.
WIDER = (0.02, 0.05)


def repeated(w: Column) -> Column:
    """Words of array w that stand in a 3-word window found twice or more in it."""
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))

    def covered(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, k: a + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3))))

    def of(t: Column) -> Column:
        ranked = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ranked, lambda q: F.filter(q, lambda e, j: F.coalesce(F.get(q, j - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(q, j + 1)["x"] == e["x"], F.lit(False))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered))

    return let(windows, of)


def quality_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("_t"), words(text).alias("_w"), F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("_l"))
    rows = rows.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated(F.col("_w")).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    }


def binomial_cdf(n: Column, k: Column, p: float | Column) -> Column:
    """P[Binomial(n, p) <= k], exact, summed in logarithms; 1 where k is at or over the mean (no test passes there)."""
    p = p if isinstance(p, Column) else F.lit(p)
    odds = p / (1 - p)
    first = n * F.log1p(-p)
    start = F.struct(first.alias("t"), first.alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i * odds)
        return let(t, lambda t: F.struct(t.alias("t"), (F.greatest(acc["s"], t) + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s")))

    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, start, add, lambda a: a["s"])))


def cutoffs(labelled: DataFrame, grids: dict[str, tuple[float, ...]] = GRIDS, risk: float = RISK, delta: float = DELTA, wider: tuple[float, ...] = WIDER) -> DataFrame:
    """stratum, ratio, cutoff, risk, n_good, good_rejected, bad_rejected from labelled (stratum, quality, and the ratios' columns).

    Each document counts once for each ratio, by how many of its grid's cutoffs it exceeds; sums from the strictest to the
    loosest then give what every cutoff would reject. All that follows the first grouping has strata * cutoffs rows.
    """
    levels = F.array(*[F.struct(F.lit(k).alias("ratio"), sum((F.when(F.col(k) > c, 1).otherwise(0) for c in grid), F.lit(0)).alias("level")) for k, grid in grids.items()])
    counts = labelled.select("stratum", "quality", F.explode(levels).alias("r")).groupBy("stratum", "r.ratio", "r.level").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    totals = counts.groupBy("stratum", "ratio").agg(F.sum("good").alias("n_good"))
    grid = F.array(*[F.struct(F.lit(k).alias("ratio"), F.lit(i + 1).alias("step"), F.lit(len(g) - i).alias("over"), F.lit(float(c)).alias("cutoff")) for k, g in grids.items() for i, c in enumerate(g)])
    steps = totals.withColumn("g", F.explode(grid)).where("g.ratio = ratio").select("stratum", "ratio", "n_good", "g.step", "g.over", "g.cutoff")
    tested = steps.join(counts, ["stratum", "ratio"]).groupBy("stratum", "ratio", "n_good", "step", "cutoff")  # a ratio over a cutoff is over all stricter ones too: over `over` of its grid
    tested = tested.agg(F.sum(F.when(F.col("level") >= F.col("over"), F.col("good")).otherwise(0)).alias("good_rejected"), F.sum(F.when(F.col("level") >= F.col("over"), F.col("bad")).otherwise(0)).alias("bad_rejected"))
    strata = counts.groupBy().agg(F.countDistinct("stratum").alias("_strata"))
    level = F.lit(delta) / (F.col("_strata") * len(grids))
    provable = F.coalesce(*[F.when(F.col("n_good") * F.log1p(F.lit(-p)) <= F.log(level), F.lit(p)) for p in (risk, *(p for p in wider if p > risk))], F.lit(risk))
    tested = tested.crossJoin(F.broadcast(strata)).withColumn("risk", provable)
    tested = tested.withColumn("_fails", F.when(binomial_cdf(F.col("n_good"), F.col("good_rejected"), F.col("risk")) <= level, 0).otherwise(1))
    so_far = Window.partitionBy("stratum", "ratio").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    passed = tested.withColumn("_failed", F.sum("_fails").over(so_far)).where("_failed = 0")
    best = Window.partitionBy("stratum", "ratio").orderBy(F.desc("bad_rejected"), "step")
    return passed.withColumn("_r", F.row_number().over(best)).where("_r = 1 and bad_rejected > 0").select("stratum", "ratio", "cutoff", "risk", "n_good", "good_rejected", "bad_rejected")


def judged(counts: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """counts (doc_id, stratum and the counts) with the ratios and kept."""
    rows = counts.withColumns(ratios())
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    limits = cutoffs(rows.join(known, rows["doc_id"] == F.col("_id")).drop("_id"), **parameters)
    wide = limits.groupBy(F.col("stratum").alias("_s")).agg(*[F.max(F.when(F.col("ratio") == k, F.col("cutoff"))).alias(f"_{k}") for k in GRIDS])
    wide = written(wide, "quality-cutoffs")
    over = [F.coalesce(F.col(k) > F.col(f"_{k}"), F.lit(False)) for k in GRIDS]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    joined = rows.join(sized_broadcast(wide, wide.count(), 10_000), rows["stratum"] == F.col("_s"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).select(*rows.columns, "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **parameters) -> DataFrame:
    """doc_id, stratum, counts, base_failed, ratios, kept for docs (doc_id, text, the stratum column)."""
    counts = quality_counts(docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")), ["doc_id", "stratum"])
    return judged(written(counts, "quality-counts"), labels.select("doc_id", "quality"), **parameters)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", *GRIDS)
