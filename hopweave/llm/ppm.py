"""Language-model scores by prediction by partial matching (PPM, method C, with symbol exclusion) over bytes.

The model is the trie of all contexts of up to `order` bytes in the training texts, held as tables and never on one machine. A
text (lower-cased, preceded by padding, followed by an end symbol) is a sequence of (order + 1)-grams of bytes, and a static
model's probability of a byte depends on its gram alone. So the work is on distinct grams:

1. Documents are dealt into blocks of about `block_bytes` by a hash of id and text, so that rows without an id spread; each block gives its distinct grams and words with their
   counts in training texts.
2. Counts are summed over blocks. Grams are then dealt by their last two context bytes: each task has whole subtrees of the
   trie and computes, for every gram that occurs anywhere, the code length along its escapes. Orders 0 and 1, which the
   subtrees share, are a table of 65,792 counts at most.
3. Every block gets back its own grams' code lengths and its own words' counts, and scores its documents.

What is shuffled grows with blocks times distinct grams and words of a block; the texts are shuffled twice, nothing is broadcast
but orders 0 and 1. At a context: p(symbol) = c / (T + q), p(escape) = q / (T + q), with c, T and q taken over the symbols that
no longer context has seen; a context without such symbols is passed through; below order 0 all bytes left are equally likely.

The unigram base has the words by 64-bit hashes.

Cases: null text is empty and has one token, its end; a null doc_id is in the fold of the empty text; rows that repeat are
scored each, also where they share an id with other texts; equal counts need no order, so ties play no part; very long texts are
scored whole, one at a time, within their block; an empty training fold leaves uniform bytes; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, load, lowered, pieces, signed, small_batches, spans, word_hashes, written

ORDER = 4
FOLDS, HELD_OUT = 5, 1
PAD, END = 0xFE, 0xFF
SYMBOLS = 255  # bytes but PAD
GRAM, WORD = 0, 1
END_WORD = np.uint64(0x5EED)


def byte_grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and of the end of each row, and where each row's grams begin. The low byte is the symbol."""
    rows = len(offs) - 1
    length = np.diff(offs)
    out = np.full(len(data) + rows * (order + 1), PAD, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1) * order + np.arange(rows), length)] = data
    ends = offs[1:] + np.arange(1, rows + 1) * order + np.arange(rows)
    out[ends] = END
    codes = np.zeros(len(out), np.int64)
    for k in range(order + 1):
        codes[k:] |= out[: len(out) - k].astype(np.int64) << (8 * k)
    real = np.ones(len(out), bool)
    begin = offs[:-1] + np.arange(rows) * (order + 1)
    for k in range(order):
        real[begin + k] = False
    return codes[real], offs[:-1] + np.arange(rows)


def tokens_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and the row of each."""
    starts, ends, row = spans(data, offs)
    h = word_hashes(data, starts, ends)
    return h, row


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def block_keys(blocks: DataFrame, order: int) -> DataFrame:
    """block, kind, key, n: distinct grams and words of each block, with their counts in training texts (0 if only elsewhere)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[tuple[int, int], int] = {}
        for batch in batches:
            block, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offs in pieces(batch, "text"):
                data = lowered(data)
                codes, begin = byte_grams(data, offs, order)
                row_of = np.repeat(np.arange(b - a), np.diff(np.concatenate([begin, [len(codes)]])))
                h, row = tokens_of(data, offs)
                h, row = np.concatenate([h, np.full(b - a, END_WORD)]), np.concatenate([row, np.arange(b - a)])
                for kind, keys, rows in ((GRAM, codes, row_of), (WORD, signed(h), row)):
                    for k in np.unique(block[a:b]).tolist():
                        mine = block[a:b][rows] == k
                        own, learn = keys[mine], train[a:b][rows[mine]]
                        for part, weight in ((own[learn], 1), (own[~learn], 0)):
                            if len(part):
                                d, n = np.unique(part, return_counts=True)
                                held.setdefault((k, kind), []).append((d, n.astype(np.int64) * weight))
                                size[k, kind] = size.get((k, kind), 0) + len(d)
                        if size.get((k, kind), 0) > 2_000_000:
                            held[k, kind] = [summed(*(np.concatenate(x) for x in zip(*held[k, kind])))]
                            size[k, kind] = len(held[k, kind][0][0])
        for (k, kind), parts in held.items():
            keys, n = summed(*(np.concatenate(x) for x in zip(*parts)))
            for i in range(0, len(keys), 200_000):
                m = len(keys[i : i + 200_000])
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(m, k), pa.int32()), "kind": pa.array(np.full(m, kind), pa.int32()), "key": keys[i : i + 200_000], "n": n[i : i + 200_000]})

    return blocks.select("block", "train", "text").mapInArrow(scan, "block int, kind int, key long, n long")


def level(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct order-k grams (context and symbol) with their counts, of those that training texts hold."""
    keys, n = summed(codes & ((1 << 8 * (k + 1)) - 1), counts)
    return keys[n > 0], n[n > 0]


def at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of wanted keys, 0 for absent ones; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0)


def code_lengths(codes: np.ndarray, counts: np.ndarray, order: int, shared: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each gram (sorted, distinct). codes hold whole subtrees from order len(shared) on; shared has the
    grams and counts of the lower orders over all texts."""
    levels = [*shared, *(level(codes, counts, k) for k in range(len(shared), order + 1))]
    total = np.zeros(len(codes))
    open_ = np.ones(len(codes), bool)
    for k in range(order, -1, -1):
        keys, n = levels[k]
        context = keys >> 8
        ctx, sums = summed(context, n)
        _, symbols = summed(context, np.ones(len(keys), np.int64))
        # of each context one byte longer: how much of this context its symbols take
        if k < order:
            longer = levels[k + 1][0]
            taken = at(keys, n, longer & ((1 << 8 * (k + 1)) - 1))
            lctx, ltaken = summed(longer >> 8, taken)
            _, lsymbols = summed(longer >> 8, np.ones(len(longer), np.int64))
        own = (codes >> 8) & ((1 << 8 * k) - 1)
        t, q = at(ctx, sums, own), at(ctx, symbols, own)
        if k < order:
            above = (codes >> 8) & ((1 << 8 * (k + 1)) - 1)
            t, q = t - at(lctx, ltaken, above), q - at(lctx, lsymbols, above)
        c = at(keys, n, codes & ((1 << 8 * (k + 1)) - 1))
        some = open_ & (q > 0)
        hit = some & (c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(hit, np.log10(c / (t + q)), np.where(some, np.log10(q / (t + q)), 0.0))
        open_ &= ~hit
    left = max(1, SYMBOLS - len(levels[0][0]))  # bytes that no training text holds
    return total - np.where(open_, np.log10(left), 0.0)


#: Grams of a subtree of two context bytes beyond which it is dealt by three, and of a task.
SUBTREE_ROWS, TASK_ROWS = 500_000, 1_000_000


def collected(grams: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-k grams with their counts in training texts, sorted."""
    key = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")
    rows = grams.groupBy(key).agg(F.sum("n").alias("n")).where("n > 0").toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def gram_lengths(grams: DataFrame, order: int, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """key, value (log10 probability) of grams (key, n: the count in all training texts).

    The trie is dealt by the last two bytes of the context, and the orders below are shared (256 ** 2 grams at most). Subtrees of
    over subtree_rows grams are counted first and dealt by three bytes, of which none has over 256 ** 2 grams at order 4; their
    order-2 grams (256 each) are shared too.
    """
    spark, depth = grams.sparkSession, min(2, order)
    two = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))
    low = [collected(grams, k) for k in range(depth)]
    heavy = [r["two"] for r in grams.groupBy(two.alias("two")).count().where(F.col("count") > subtree_rows).collect()] if order > 2 else []  # 256 ** 2 at most
    marked = grams.select("key", "n", two.alias("two")).join(F.broadcast(spark.createDataFrame([(h, True) for h in heavy], "two long, deep boolean")), "two", "left")
    if heavy:
        low.append(collected(marked.where("deep"), depth))
    shared = spark.sparkContext.broadcast(low)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        codes, n, deep = (np.concatenate(x) for x in zip(*parts))
        order_ = np.argsort(codes)
        codes, n, deep = codes[order_], n[order_], deep[order_]
        for some, levels in ((~deep, depth), (deep, depth + 1)):
            if not some.any():
                continue
            keys, values = codes[some], code_lengths(codes[some], n[some], order, shared.value[:levels])
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_pydict({"key": keys[i : i + 200_000], "value": values[i : i + 200_000]})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // TASK_ROWS))
    three = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 24) - 1))
    dealt = marked.select("key", "n", F.coalesce("deep", F.lit(False)).alias("deep"), "two").repartition(parts, F.when(F.col("deep"), three + (1 << 24)).otherwise(F.col("two")))
    return dealt.select("key", "n", "deep").mapInArrow(scan, "key long, value double")


def score_block(order: int):
    def score(key, docs: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for kind in (GRAM, WORD):
            own = values[values["kind"] == kind].sort_values("key")
            tables.append((own["key"].to_numpy(np.int64), own["value"].to_numpy(np.float64)))
        (gk, gv), (wk, wv) = tables
        out = []
        batch = pa.RecordBatch.from_arrays([pa.array(docs["text"], pa.large_string())], names=["text"])
        for a, b, data, offs in pieces(batch, "text"):
            data = lowered(data)
            codes, begin = byte_grams(data, offs, order)
            score = np.add.reduceat(gv[np.searchsorted(gk, codes)], begin)
            h, row = tokens_of(data, offs)
            h, row = signed(np.concatenate([h, np.full(b - a, END_WORD)])), np.concatenate([row, np.arange(b - a)])
            c = wv[np.searchsorted(wk, h)]
            out.append(pd.DataFrame({"n_tokens": np.bincount(row, minlength=b - a), "n_known": np.bincount(row, c > 0, minlength=b - a).astype(np.int64), "logs": np.bincount(row, np.log10(c + 0.5), minlength=b - a), "score": score, "n_bytes": np.diff(offs)}))
        return pd.concat([docs[["doc_id", "train"]].reset_index(drop=True), pd.concat(out, ignore_index=True)], axis=1)

    return score


def ppm_scores(docs: DataFrame, train: Column | None = None, order: int = ORDER, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes (without the end) of docs (doc_id, text)."""
    spark = docs.sparkSession
    train = (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) if train is None else train
    rows = small_batches(docs).select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block")
    found = written(block_keys(blocks, order), "ppm-counts")
    # a word or gram has a row for each block, added up before they meet
    totals = written(found.groupBy("kind", "key").agg(F.sum("n").alias("total")), "ppm-totals")
    words, grams = totals.where(f"kind = {WORD}").select("key", "total"), totals.where(f"kind = {GRAM}").select("key", F.col("total").alias("n"))
    facts = words.agg(F.sum("total").alias("n"), F.sum(F.when(F.col("total") > 0, 1).otherwise(0)).alias("v")).first()
    n, v = int(facts["n"] or 0), int(facts["v"] or 0)
    of_words = found.where(f"kind = {WORD}").select("block", "kind", "key").join(words.select("key", F.col("total").cast("double").alias("value")), "key")
    of_grams = found.where(f"kind = {GRAM}").select("block", "kind", "key").join(gram_lengths(grams, order), "key")
    values = of_grams.unionByName(of_words).select("block", "kind", "key", "value")
    scored = blocks.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(score_block(order), "doc_id long, train boolean, n_tokens long, n_known long, logs double, score double, n_bytes long")
    each = F.log10(F.lit(n + 0.5 * (v + 1)))
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * each).alias("base_score"), "score", "n_bytes")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm_scores(load(spark, sf_dir, "documents"))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
