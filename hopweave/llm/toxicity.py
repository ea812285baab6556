"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows (`sample_docs` documents at most in expectation, texts that repeat counted once):
1. Evidence of pieces. A piece is a word or a prefix of 4 to 7 letters of one, so that a stem with many endings is learned from
   all of them. Log-odds of a piece's share of the words of toxic and of other documents, with an informative Dirichlet prior
   (the sample's own frequencies, worth `prior` words), and the z-score; and the same over documents that hold the piece at least
   once (prior worth `prior_docs` documents), so that one text's repetitions are no evidence. A piece counts if its z is over
   `least_z` by words and over `least_z_docs` by documents; with z the smaller of the two it scores its log-odds by words times
   z^2 / (z^2 + 9). A piece that only one toxic document of the sample holds is no evidence, however often it stands there: a word
   that marks just that one text is not learned. A word scores what its best-supported piece scores (the largest z; the longer of equals), -`drift` without any.
2. lambda and K of the extreme-value law of the best segment of a random text: lambda solves E[exp(lambda * score)] = 1 over
   the words of the other documents; K is fitted to their best segments.
3. A logistic curve, on documents that step 1 has not seen, over log(1 + evidence) of a text's passages.

Scan: the linear-time algorithm of Ruzzo and Tompa finds all maximal scoring segments; the words between positive ones are
summed up, so its work is in the number of positive words. A segment whose P-value in a random text of this length is below
`SIGNIFICANT` is a passage. A text's evidence is -log P of its r best segments together, by the extreme-value law of sums, with
the r that gives most (each r pays r log 2 for the choice); every r is tried, up to all of a text's segments.

Cases: null and empty texts have no segments and get the score of texts without any; null labels or doc_ids teach nothing, of
several labels of a document the worst holds; without labels, or of one kind only, every score is that kind's share (0 without
labels); ties between scores are left as they are; rows that repeat are scored each; very long texts are scanned whole, a text at
a time; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IN_ALNUM, fold, fold_of, load, lowered, mix, pieces, signed, sized_broadcast, small_batches, spans, word_hashes

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS, PRIOR, PRIOR_DOCS, LEAST_Z, LEAST_Z_DOCS, DRIFT = 20_000, 10_000.0, 20.0, 4.0, 2.0, 0.1
STEMS = (4, 5, 6, 7)
SIGNIFICANT = 0.05
KNOWN_WORDS = 1 << 20  # places for words that a worker has looked up, a word in one place, the last one stays (16 MB)
SCAN_BYTES = 1_000_000  # of text at once
CUT = 0.3


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    total = 0.0
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at its end
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, left, right = i, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                kept.append((start, i + 1, left, right))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, r - le) for a, b, le, r in kept]


def passages(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """Maximal segments (first word, end word, score) of a text whose words score -drift but for those at the positions at."""
    line, where = [], []
    for k in range(len(at)):
        gap = int(at[k] - at[k - 1]) - 1 if k else 0
        if gap:
            line.append(-drift * gap)
            where.append((-1, -1))
        line.append(float(score[k]))
        where.append((int(at[k]), int(at[k]) + 1))
    return [(where[a][0], where[b - 1][1], s) for a, b, s in segments(line)]


def word_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of piece hashes for each word: its prefixes of STEMS letters (0 where it is shorter), and itself."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    first, last = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    begins = np.concatenate([begins, [len(data)]])
    out = np.zeros((len(starts), len(STEMS) + 1), np.uint64)
    for j, k in enumerate(STEMS):
        some = np.flatnonzero(last - first >= k)
        out[some, j] = word_hashes(data, starts[some], begins[first[some] + k])
    out[:, -1] = mix(word_hashes(data, starts, ends) ^ np.uint64(0xA11))  # a word is another piece than a prefix of its letters
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct words, and which of them each word is."""
    _, place, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return place, which


class Model:
    def __init__(self, keys: np.ndarray, scores: np.ndarray, support: np.ndarray, drift: float, lam: float = 1.0, k: float = 1.0, curve: tuple[float, float] = (0.0, 0.0)):
        order = np.argsort(keys)
        self.keys, self.scores, self.support = keys[order], scores[order], support[order]
        self.drift, self.lam, self.k, self.curve = drift, lam, k, curve
        self._words: np.ndarray | None = None
        self._best: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": None, "_best": None}  # a worker keeps what it has looked up

    def best_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The index of each word's best-supported piece, -1 without one."""
        h = word_pieces(data, starts, ends)[:, ::-1]  # longest first
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        z = np.where(self.keys[i] == h, self.support[i], -1.0)
        best, rows = z.argmax(axis=1), np.arange(len(h))
        return np.where(z[rows, best] >= 0, i[rows, best], -1)

    def chosen(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """best_pieces of words that may recur: a distinct word is looked up once, and known to the texts that follow."""
        if not len(self.keys) or not len(starts):
            return np.full(len(starts), -1)
        h = word_hashes(data, starts, ends)
        if self._words is None:
            self._words, self._best = np.zeros(KNOWN_WORDS, np.uint64), np.full(KNOWN_WORDS, -1)
        at = (h % np.uint64(KNOWN_WORDS)).astype(np.int64)
        out, new = self._best[at], np.flatnonzero(self._words[at] != h)
        if len(new):
            fresh, place, which = np.unique(h[new], return_index=True, return_inverse=True)
            place = new[place]
            best = self.best_pieces(data, starts[place], ends[place])
            out[new] = best[which]
            self._words[at[place]], self._best[at[place]] = fresh, best
        return out

    def p_value(self, score: float, n_words: int) -> float:
        """P[a random text of so many words has a segment as good]."""
        return -math.expm1(-self.k * max(n_words, 1) * math.exp(-self.lam * score))

    def evidence(self, found: list[tuple[int, int, float]], n_words: int) -> float:
        """-log P of the text's best segments together; 0 without one."""
        if not found:
            return 0.0
        level = math.log(self.k * max(n_words, 1))
        best = np.sort(self.lam * np.array([s for _, _, s in found]) - level)[::-1]
        first = float(best[0])
        top = (-math.log(max(-math.expm1(-math.exp(min(-first, 50.0))), 1e-300)) if first < 30 else first) - math.log(2)
        total, r = np.cumsum(best), np.arange(1, len(best) + 1)
        some = (r > 1) & (best > 0) & (total > r)
        if some.any():  # P[sum of r > T] ~ exp(-T) T^(r-1) / (r! (r-1)!)
            factorial = np.concatenate([[0.0], np.cumsum(np.log(r))])  # log r! at r
            sums = total[some] - (r[some] - 1) * np.log(total[some]) + factorial[r[some]] + factorial[r[some] - 1] - r[some] * math.log(2)
            top = max(top, float(sums.max()))
        return max(top, 0.0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence), -30, 30)))

    def scan(self, batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Words and positive segments of each text of a batch."""
        for a, b, data, offs in pieces(batch, "text", SCAN_BYTES):
            data = lowered(data)
            starts, ends, row = spans(data, offs, IN_ALNUM)
            i = self.chosen(data, starts, ends)
            n_words = np.bincount(row, minlength=b - a)
            first = np.concatenate([[0], np.cumsum(n_words)])
            hit = np.flatnonzero(i >= 0)
            value, edges = self.scores[i[hit]], np.searchsorted(hit, first)
            for r in range(b - a):
                x, y = edges[r], edges[r + 1]
                yield int(n_words[r]), passages(hit[x:y] - first[r], value[x:y], self.drift) if y > x else []


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """text, doc_id, toxic of the sample, outside the held-out fold; texts that repeat are one row, with their smallest id and worst label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = sample_docs / max(1, known.count())
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.join(sized_broadcast(picked, picked.count(), 4 * sample_docs), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))


def piece_counts(sample: DataFrame) -> DataFrame:
    """key, y1, y0, d1, d0: occurrences of each piece (by its hash) in toxic and other documents, and documents that hold it.
    Key 0 has all words and all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
            for a, b, data, offs in pieces(batch, "text"):
                data = lowered(data)
                starts, ends, row = spans(data, offs, IN_ALNUM)
                place, which = distinct_words(data, starts, ends)
                n = max(1, len(place))
                cells, times = np.unique(row * n + which, return_counts=True)
                h = word_pieces(data, starts[place], ends[place])[cells % n]  # of each (row, distinct word)
                doc, times = np.repeat(cells // n, h.shape[1]), np.repeat(times, h.shape[1])
                h = h.ravel()
                real = h != 0
                h, doc, times = h[real], doc[real], times[real]
                h, doc, times = np.concatenate([h, np.zeros(b - a, np.uint64)]), np.concatenate([doc, np.arange(b - a)]), np.concatenate([times, np.bincount(row, minlength=b - a)])
                order = np.lexsort((doc, h))
                h, doc, times = h[order], doc[order], times[order]
                new_key = np.concatenate([[True], h[1:] != h[:-1]])
                new_doc = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
                bad = toxic[a:b][doc] == 1
                at = np.flatnonzero(new_key)
                sums = [np.add.reduceat(x.astype(np.int64), at) for x in (times * bad, times * ~bad, new_doc & bad, new_doc & ~bad)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), *map(pa.array, sums)], names=["key", "y1", "y0", "d1", "d0"])

    parts = sample.mapInArrow(count, "key long, y1 long, y0 long, d1 long, d0 long")
    return parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("y1", "y0", "d1", "d0")])


def log_odds(a: Column, b: Column, all_a: float, all_b: float, prior: float) -> tuple[Column, Column]:
    """Log-odds of a among all_a against b among all_b with a Dirichlet prior from both together, and its z-score."""
    alpha = (a + b) * (prior / max(1.0, all_a + all_b))
    odds = lambda y, n: F.log((y + alpha) / F.greatest(F.lit(n + prior) - y - alpha, F.lit(1e-9)))
    delta = odds(a, all_a) - odds(b, all_b)
    return delta, delta / F.sqrt(1 / (a + alpha) + 1 / (b + alpha))


def evident_pieces(counts: DataFrame, prior: float, prior_docs: float, least_z: float, least_z_docs: float) -> DataFrame:
    """key, score, support of the pieces that count; found in the tables, so only they reach the driver."""
    every = counts.where("key = 0").first()
    n1, n0, t1, t0 = (float(every[c]) for c in ("y1", "y0", "d1", "d0")) if every else (0.0, 0.0, 0.0, 0.0)
    delta, z = log_odds(F.col("y1"), F.col("y0"), n1, n0, prior)
    delta_docs, z_docs = log_odds(F.col("d1"), F.col("d0"), t1, t0, prior_docs)
    rows = counts.where("key <> 0 and d1 > 1").select("key", delta.alias("delta"), z.alias("z"), delta_docs.alias("delta_docs"), z_docs.alias("z_docs"))
    good = rows.where((F.col("delta") > 0) & (F.col("delta_docs") > 0) & (F.col("z") > least_z) & (F.col("z_docs") > least_z_docs)).withColumn("support", F.least("z", "z_docs"))
    return good.select("key", (F.col("delta") * F.col("support") ** 2 / (F.col("support") ** 2 + 9)).alias("score"), "support")


def scanned(sample: DataFrame, model: Model) -> DataFrame:
    """toxic, n_words, best (segment), evidence, part of each document of the sample, by this model."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, max((s for _, _, s in found), default=0.0), shared.value.evidence(found, n)) for n, found in shared.value.scan(batch)]
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(batch.schema.get_field_index("toxic")).cast(pa.int32()), "n_words": pa.array([r[0] for r in rows], pa.int64()), "best": pa.array([r[1] for r in rows], pa.float64()), "evidence": pa.array([r[2] for r in rows], pa.float64()), "part": pa.array([fold(f"part{i}", 4) for i in ids], pa.int32())})

    return sample.mapInArrow(scan, "toxic int, n_words long, best double, evidence double, part int")


def calm_uses(sample: DataFrame, model: Model) -> np.ndarray:
    """How many words of the sample's other documents each piece of the model scores; last, all their words."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(shared.value.keys) + 1, np.int64)
        for batch in batches:
            for _, _, data, offs in pieces(batch, "text"):
                data = lowered(data)
                starts, ends, _ = spans(data, offs, IN_ALNUM)
                i = shared.value.chosen(data, starts, ends)
                out[:-1] += np.bincount(i[i >= 0], minlength=len(out) - 1)
                out[-1] += len(i)
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(out)), "n": out})

    rows = sample.where("toxic = 0").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(model.keys) + 1)
    out[rows["i"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of P = 1 / (1 + exp(-(a + b x))), slightly regularised, by Newton's method."""
    x1, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), g)
        w += np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, prior: float = PRIOR, prior_docs: float = PRIOR_DOCS, least_z: float = LEAST_Z, least_z_docs: float = LEAST_Z_DOCS, drift: float = DRIFT) -> Model:
    sample = labelled_sample(small_batches(docs), labels, sample_docs).persist()
    part = F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string"))) % 4
    counts = piece_counts(sample.where(part != 0)).persist()
    found = evident_pieces(counts, prior, prior_docs, least_z, least_z_docs).toPandas()
    counts.unpersist()
    model = Model(found["key"].to_numpy(np.int64).view(np.uint64), found["score"].to_numpy(float), found["support"].to_numpy(float), drift)
    uses = calm_uses(sample, model)
    model.lam = root(model.scores, uses[:-1] / max(uses[-1], 1.0), drift)
    seen = scanned(sample, model).toPandas()
    calm = seen[(seen["toxic"] == 0) & (seen["best"] > 0)]
    if len(calm):  # mean of K n exp(-lambda best) is 1 if the law holds
        model.k = float(np.clip(1 / np.mean(np.maximum(calm["n_words"], 1) * np.exp(-model.lam * calm["best"])), 1e-6, 1.0))
    else:
        model.k = 0.01
    seen = scanned(sample, model).toPandas()  # now with K
    sample.unpersist()
    unseen = seen[seen["part"] == 0]
    if unseen["toxic"].nunique() < 2:
        unseen = seen
    y = (unseen["toxic"] == 1).to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        model.curve = logistic(np.log1p(unseen["evidence"].to_numpy(float)), y)
    else:
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        model.curve = (float(np.log(p / (1 - p))), 0.0)
    return model


def root(scores: np.ndarray, share: np.ndarray, drift: float) -> float:
    """lambda > 0 with sum(share * exp(lambda * score)) + (1 - sum(share)) * exp(-lambda * drift) = 1, by bisection."""
    if not len(scores):
        return 1.0

    def excess(lam: float) -> float:
        return float((np.maximum(share, 1e-9) * np.exp(np.minimum(lam * scores, 600))).sum() + (1 - share.sum()) * np.exp(-lam * drift) - 1)

    low, high = 1e-4, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    return high


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, passages (significant ones: start and end in words, score, p_value; best first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = list(own.scan(batch))
            n = np.array([r[0] for r in rows], np.int64)
            p = own.probability(np.array([own.evidence(r[1], r[0]) for r in rows], float))
            found = [[{"start": a, "end": b, "score": s, "p_value": v} for a, b, s in sorted(r[1], key=lambda x: (-x[2], x[0])) if (v := own.p_value(s, r[0])) < SIGNIFICANT] for r in rows]
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([fold(i, FOLDS) == HELD_OUT for i in ids.to_pylist()], pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= CUT).astype(np.int32)), pa.array(n), pa.array(found, kind)], names=["doc_id", "held_out", "score", "predicted", "n_words", "passages"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int, n_words long, passages array<struct<start: long, end: long, score: double, p_value: double>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
