"""Benchmark decontamination by exact matching of n-word windows, in DataFrame operations alone.

Every window of `n` consecutive words of a benchmark item (an item of fewer words is one window) is kept once, with the items it
stands in, under a hash of its words. Training texts are cut into words once, and every n words of them, and every m words for
the sizes m of short items, are hashed and looked up in that set; a hash that is found counts only if the words are the
window's. The set is broadcast while its counted rows are within `broadcast_rows`, and hits are verified where they are found.
Beyond it hashes are joined by shuffle, each with its place alone, and what is found is verified with the texts joined back.
Hits are written once; counts and items are taken from there.

Cases: null and empty texts have no words and no hits; an item without words has no window; null item_ids count as hits but are
not listed; rows that repeat (same id and text) are reported each, with the same counts; rows of one id and different texts are
told apart; items of equal windows are all listed; an empty benchmark leaves all documents clean; an empty table gives no rows;
very long texts give as many hashes as words, a row each; overlapping hits count a word once, and there are no other ties; `decontaminate` replaces columns of docs that have the names of its
own, the others leave every column of docs as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ascii_lower, columns, load, sized_broadcast, unused, words, written

#: NOT_ALNUM for texts that are not lower-cased: it finds as many words.
NOT_ALNUM_ANY = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Bytes of windows broadcast at most, and the salts of their places beyond that.
BROADCAST_BYTES, SALTS = 64 << 20, 16


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), NOT_ALNUM)


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hash, window (its words), size, win) of each distinct window, win being a digest of its words, and (win, item_id) of the
    items it stands in."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    rows = items.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i") + 1, n).alias("window"))
    win = F.unhex(F.md5(F.array_join("window", " "))).alias("win")
    windows = rows.select("window").distinct().select(F.xxhash64(word_hashes(F.col("window"))).alias("hash"), "window", F.size("window").alias("size"), win)
    return windows, rows.select(win, "item_id").distinct()


def text_windows(cut: DataFrame, sizes: list[int]) -> DataFrame:
    """cut (with w) with start and hash of every run of so many words, a row each; nothing of texts that are shorter."""
    rows = cut.withColumn("h", word_hashes(F.col("w")))
    rows = rows.select("*", F.posexplode("h").alias("start", "_h")).drop("_h")
    rows = rows.withColumn("m", F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(F.lit, sizes))))
    return rows.where(F.col("start") + F.col("m") <= F.size("h")).withColumn("hash", F.xxhash64(F.slice("h", F.col("start") + 1, F.col("m")))).drop("h", "m")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def find_hits(docs: DataFrame, windows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, digest (of the text), start, end (word positions), win: every occurrence of one of the windows (written).

    Windows are broadcast while their counted bytes are within the bound. Beyond it places and windows meet by hash and salt, so
    that the places of a very common window are dealt over SALTS tasks at least.
    """
    facts = {r["size"]: (r["n"], r["bytes"]) for r in windows.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("window", "")) + 24 * F.size("window") + 100).alias("bytes")).collect()}  # n rows at most
    found = ["doc_id", "digest", "start", (F.col("start") + F.col("size")).alias("end"), "win"]
    cut = docs.select("doc_id", text_key(F.col("text")).alias("digest"), item_words(F.col("text")).alias("w"))
    if not facts:
        return cut.join(windows, F.lit(False)).withColumn("start", F.lit(0)).select(*found)
    is_window = F.slice("w", F.col("start") + 1, F.col("size")) == F.col("window")
    runs = text_windows(cut, sorted(facts))
    if sum(b for _, b in facts.values()) <= broadcast_bytes:
        return runs.join(F.broadcast(windows), "hash").where(is_window).select(*found)
    places = runs.drop("w").withColumn("salt", F.pmod(F.xxhash64("start", "doc_id"), F.lit(SALTS)).cast("int"))
    dealt = windows.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    texts = cut.dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "w")
    possible = written(places.join(dealt, ["hash", "salt"]), "leak-places")
    return possible.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g"))).where(is_window).select(*found)


def hit_documents(hits: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, digest, n_hit (distinct words hit), n_items, items (sorted as strings, comma-joined): only documents with a hit.
    members (win, item_id) are joined to each document's distinct windows, so an item list is made once a document."""
    key = ["doc_id", "digest"]
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = hits.select(*key, "start", "end").distinct().withColumn("_n", F.greatest(fresh, F.lit(0)))
    n_hit = covered.groupBy(*key).agg(F.sum("_n").cast("long").alias("n_hit"))
    items = hits.select(*key, "win").distinct().join(members, "win").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy(*key).agg(F.collect_set("item").alias("i"))
    named = items.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), F.size("i").cast("long").alias("n_items"), F.array_join(F.array_sort("i"), ",").alias("items"))
    return n_hit.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g"))).drop("_d", "_g")


def prepared(benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    windows, members = benchmark_windows(benchmark.select("item_id", "text"), n)
    return written(windows, "leak-windows"), written(members, "leak-members")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """hit_documents of docs, written."""
    windows, members = prepared(benchmark, n)
    hits = written(find_hits(docs.select("doc_id", "text"), windows, broadcast_bytes), "leak-hits")
    return written(hit_documents(hits, members), "leak-documents")


def of_document(docs: DataFrame, found: DataFrame, most: int = 500_000) -> tuple[DataFrame, Column]:
    """found (doc_id, digest, ...) under names that no column of docs has, as _name of each, and the condition that joins it."""
    mark = unused(docs, "leak")
    other = sized_broadcast(found.select(*[F.col(c).alias(f"{mark}_{c}") for c in found.columns]), found.count(), most)
    same = docs["doc_id"].eqNullSafe(other[f"{mark}_doc_id"]) & (text_key(docs["text"]) == other[f"{mark}_digest"])
    return other, same


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items and contaminated; columns of docs with these names give way."""
    found, rest = leaks(docs, benchmark, n, broadcast_bytes), docs.drop("n_words", "n_hit", "n_items", "items", "contaminated")
    other, same = of_document(rest, found)
    mark = other.columns[0].removesuffix("_doc_id")
    return rest.join(other, same, "left").select(
        *columns(rest.columns),
        F.size(words(F.col("text"), NOT_ALNUM_ANY)).cast("long").alias("n_words"),
        F.coalesce(f"{mark}_n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(f"{mark}_n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(f"{mark}_items", F.lit("")).alias("items"),
        F.col(f"{mark}_n_hit").isNotNull().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without those that have a hit; all columns as they are."""
    other, same = of_document(docs, leaks(docs, benchmark, n, broadcast_bytes).select("doc_id", "digest"))
    return docs.join(other, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text: the words that no window hits, in order, joined by single spaces (lower-cased); a text without hits stays as it is."""
    hits = find_hits(docs.select("doc_id", "text"), prepared(benchmark, n)[0], broadcast_bytes).select("doc_id", "digest", F.struct("start", "end").alias("s")).distinct()
    spans = hits.groupBy("doc_id", "digest").agg(F.collect_list("s").alias("_s")).select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "_s")
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("_key")).join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_g")), "left")
    kept = F.filter(item_words(F.col("text")), lambda w, i: ~F.exists("_s", lambda s: (s["start"] <= i) & (i < s["end"])))
    return rows.select("doc_id", F.when(F.col("_s").isNull(), F.col("text")).otherwise(F.array_join(kept, " ")).alias("text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = decontaminate(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return checked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
short AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, short, unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT dw.r, dw.i, bw.n, bw.item_id FROM dw JOIN bw USING (g, n)),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
k AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items, sha256(coalesce(k.items, '')) AS items_sha256, c.r IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN k ON k.r = d.r
"""
