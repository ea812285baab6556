"""Language identification, words first: known words score by their log frequency in each language, unseen ones by the longest
character n-grams that are known.

The model is fitted on a bounded sample of labelled rows: about `sample_docs` training documents of each language (those whose
hash is below the share that gives so many; all where there are fewer). Every word and n-gram of the sample is kept, by a 64-bit
hash, in a table in the shared folder that tasks read themselves; the driver sees sums by language only. Prediction reads whole
texts of all rows.

A word is a run of letters and combining marks, lower-cased. Its score in a language is log((c + 0.1) / (N + 0.1 V)): its count,
the count of all words of the language, and the distinct words of all languages. An unseen word takes the mean of the same
scores of its n-grams (with ^ before and $ after it) of the greatest length, 5 to 1, of which any is known; nothing without any.

Cases: null text, text without a letter, or no training rows: `und` with score 0; a null lang teaches nothing; ties between
languages go to the first by name; rows that repeat are predicted each; an empty table gives no rows; very long texts are scored
in runs of `RUN` characters that end between words; other columns are left as they are, but `held_out`, `lang_pred` and `score`
give way in `identify` (`guess` takes a name that none of them has).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, fold_of, hand_back, load, signed, sized_broadcast, small_batches, spans, store, tidy, unused, word_hashes, written_at

LONGEST = 5
SAMPLE_DOCS = 2500
FOLDS, HELD_OUT = 3, 1
RUN = 1_000_000
FLOOR = 0.1  # added to every count
MOST_LANGS = 100_000  # rows of the table of shares that are broadcast at most
BEFORE, AFTER = ord("^"), ord("$")

_kinds: list[np.ndarray] = []


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and may it stand in a word (a letter or a mark)?"""
    if not _kinds:
        letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        mark = np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        _kinds.extend((letter, letter | mark))
    return _kinds[0], _kinds[1]


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def runs(texts: list[str | None], most: int | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, pieces) of about `most` lower-cased characters; a longer text goes in several pieces that end between words."""
    most = most or RUN
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while at < len(text) or not text:
            end = min(len(text), at + most)
            while end < len(text) and kinds()[1][ord(text[end])]:
                end += 1
            rows.append(row)
            parts.append(text[at:end])
            size += end - at
            if size >= most:
                yield rows, parts
                rows, parts, size = [], [], 0
            at = end
            if not text:
                break
    if rows:
        yield rows, parts


def words_of(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, and start, end, part and hash of each word; then which parts have a letter, in the last place."""
    cps = code_points("".join(parts))
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    starts, ends, row = spans(cps, offs, kinds()[1])
    return cps, starts, ends, row, hashed(cps, starts, ends)


def hashed(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_hashes(cps.view(np.uint8), starts * 4, ends * 4)


def gram_places(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of words of these lengths that follow each other, each n-gram's place and its word."""
    each = np.maximum(lengths - n + 1, 0)
    word = np.repeat(np.arange(len(lengths)), each)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(each)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    return first[word] + np.arange(len(word)) - before[word], word


def framed(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ^word$ for each word, one after the other, and their lengths."""
    lengths = ends - starts + 2
    out = np.full(int(lengths.sum()), BEFORE, "<u4")
    last = np.cumsum(lengths) - 1
    out[last] = AFTER
    inner = np.ones(len(out), bool)
    inner[last] = inner[last - lengths + 1] = False
    place = np.arange(int((ends - starts).sum())) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    out[inner] = cps[np.repeat(starts, ends - starts) + place]
    return out, lengths


def training_rows(docs: DataFrame, sample_docs: int) -> DataFrame:
    """lang, text of the sample: rows outside the held-out fold, by a hash of the id below each language's share."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "lang", "text")
    share = rows.groupBy("lang").agg((F.lit(float(sample_docs)) / F.count("*")).alias("_share"))
    u = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    return rows.withColumn("_u", u).join(sized_broadcast(share, share.count(), MOST_LANGS), "lang").where("_u < _share").select("lang", "text")


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, n (0: words), gram (its hash), count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, which = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for rows, parts in runs(batch.column(1).to_pylist()):
                cps, starts, ends, row, h = words_of(parts)
                of = which[np.array(rows, np.int64)[row]]
                for k, lang in enumerate(langs.tolist()):
                    mine = np.flatnonzero(of == k)
                    keys, place, times = np.unique(h[mine], return_index=True, return_counts=True)
                    out = [(0, keys, times)]
                    text, lengths = framed(cps, starts[mine][place], ends[mine][place])
                    for n in range(1, LONGEST + 1):
                        at, word = gram_places(lengths, n)
                        grams, which_gram = np.unique(hashed(text, at, at + n), return_inverse=True)
                        out.append((n, grams, np.bincount(which_gram, times[word], minlength=len(grams)).astype(np.int64)))
                    for n, keys, times in out:
                        if len(keys):
                            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "n": pa.array(np.full(len(keys), n), pa.int32()), "gram": pa.array(signed(keys)), "count": pa.array(times, pa.int64())})

    return rows.mapInArrow(tidy(count), "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


class Level:
    """Words or n-grams of one length: sorted keys, and the languages and scores above the floor of each, one after the other."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, score: np.ndarray, floor: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.edges = keys[first], np.concatenate([first, [len(keys)]])
        self.lang, self.score, self.floor = lang[order].astype(np.int32), (score[order] - floor[lang[order]]).astype(np.float32), floor

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, i, -1)

    def add(self, out: np.ndarray, rows: np.ndarray, places: np.ndarray, by: np.ndarray | float = 1.0) -> None:
        """out[rows] += by * the scores above the floor of the keys at these places."""
        each = self.edges[places + 1] - self.edges[places]
        at = np.repeat(self.edges[places] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        weight = self.score[at] * (np.repeat(by, each) if isinstance(by, np.ndarray) else by)
        out += np.bincount(np.repeat(rows, each) * out.shape[1] + self.lang[at], weight, minlength=out.size).reshape(out.shape)


class Model:
    """langs; the table of counts (lang, n, gram, count) at path; totals[n, lang] and distinct[n] of all that it has."""

    def __init__(self, langs: list[str], path: str | None, totals: np.ndarray, distinct: np.ndarray):
        self.langs, self.path, self.totals, self.distinct = langs, path, totals, distinct
        self._levels: list[Level] = []
        self._rows: dict[int, int] = {}
        self._scores = np.zeros((1024, max(1, len(langs))))

    @classmethod
    def fit(cls, docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
        counts, path = written_at(gram_counts(training_rows(small_batches(docs), sample_docs)), "language-counts")
        sums = counts.groupBy("lang", "n").agg(F.sum("count")).collect()  # LONGEST + 1 rows a language
        langs = sorted({r[0] for r in sums})
        totals, distinct = np.ones((LONGEST + 1, max(1, len(langs)))), np.zeros(LONGEST + 1)
        for lang, n, total in sums:
            totals[n, langs.index(lang)] = total
        for n, keys in counts.groupBy("n").agg(F.countDistinct("gram")).collect():  # LONGEST + 1 rows
            distinct[n] = keys
        return cls(langs, path if langs else None, totals, distinct)

    def __getstate__(self) -> tuple:
        return self.langs, self.path, self.totals, self.distinct  # tables are read where they are used

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @property
    def levels(self) -> list[Level]:
        if not self._levels:
            fs, path = store(self.path)
            found = pq.read_table(path, filesystem=fs)
            names = pa.chunked_array(found.column("lang")).combine_chunks() if found.num_rows else pa.array([], pa.string())
            lang = pa.compute.index_in(names, pa.array(self.langs, pa.string())).to_numpy(zero_copy_only=False)
            n_of, keys, count = found.column("n").to_numpy(), found.column("gram").to_numpy().view(np.uint64), found.column("count").to_numpy()
            for n in range(LONGEST + 1):
                mine = np.flatnonzero(n_of == n)
                every = self.totals[n] + FLOOR * max(1.0, self.distinct[n])
                self._levels.append(Level(keys[mine], lang[mine], np.log((count[mine] + FLOOR) / every[lang[mine]]), np.log(FLOOR / every)))
        return self._levels

    def forget(self) -> None:
        """Drops the tables, which are read again where they are wanted: a worker that lives on would keep them."""
        self._levels.clear()

    def known(self, n: int, gram: str) -> np.ndarray | None:
        """Scores by language of a word (n = 0) or an n-gram, None for an unknown one."""
        cps = code_points(gram)
        level = self.levels[n]
        place = level.find(hashed(cps, np.array([0]), np.array([len(cps)])))
        if place[0] < 0:
            return None
        out = np.zeros((1, len(self.langs)))
        level.add(out, np.array([0]), place)
        return out[0] + level.floor

    def score(self, word: str) -> np.ndarray:
        cps = code_points(word)
        return self.scores(cps, np.array([0]), np.array([len(cps)]), hashed(cps, np.array([0]), np.array([len(cps)])))[0]

    def scores(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A row of scores for each word."""
        out = np.zeros((len(h), len(self.langs)))
        place = self.levels[0].find(h)
        seen = np.flatnonzero(place >= 0)
        self.levels[0].add(out, seen, place[seen])
        out[seen] += self.levels[0].floor
        left = np.flatnonzero(place < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            text, lengths = framed(cps, starts[left], ends[left])
            at, word = gram_places(lengths, n)
            place = self.levels[n].find(hashed(text, at, at + n))
            word, place = word[place >= 0], place[place >= 0]
            found = np.bincount(word, minlength=len(left))
            self.levels[n].add(out, left[word], place, 1.0 / found[word])
            out[left[found > 0]] += self.levels[n].floor
            left = left[found == 0]
        return out

    def cached(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, keep: int = 200_000) -> np.ndarray:
        """scores(...) of distinct words, those of earlier calls from memory."""
        rows = self._rows
        if len(rows) > keep:
            rows.clear()
        keys = h.tolist()
        new = np.array([i for i, k in enumerate(keys) if k not in rows], np.int64)
        if len(new):
            n = len(rows)
            while n + len(new) > len(self._scores):
                self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
            self._scores[n : n + len(new)] = self.scores(cps, starts[new], ends[new], h[new])
            rows.update(zip(h[new].tolist(), range(n, n + len(new))))
        return self._scores[[rows[k] for k in keys]]

    def guess(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        n, found = len(texts), np.zeros(len(texts), bool)
        sums = np.zeros((n, len(self.langs)))
        for rows, parts in runs(texts) if self.langs else ():
            cps, starts, ends, row, h = words_of(parts)
            if not len(h):
                continue
            of = np.array(rows, np.int64)[row]
            has = np.logical_or.reduceat(kinds()[0][cps], starts) if len(starts) else np.zeros(0, bool)  # up to the next word: no letter stands between words
            found[of[has]] = True
            keys, place, which = np.unique(h, return_index=True, return_inverse=True)
            score = self.cached(cps, starts[place], ends[place], keys)
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(of, score[which, k], minlength=n)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        best = sums.argmax(axis=1)
        score = 1.0 / np.exp(np.clip(sums - sums[np.arange(n), best][:, None], -700, 0)).sum(axis=1)
        return [self.langs[b] if f else "und" for b, f in zip(best.tolist(), found.tolist())], np.where(found, score, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, score = self.guess([text])
        return lang[0], float(score[0])


#: Texts that are scored at once: what they need grows with their words.
GUESS_ROWS = 250


def guess(docs: DataFrame, model: Model | None = None, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, str]:
    """docs with a struct (lang_pred, score) under a name that no column of docs has, and that name."""
    model = model or Model.fit(docs, sample_docs)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), unused(docs, "guess")

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for some in texts:
            langs, scores = [], []
            for a in range(0, len(some), GUESS_ROWS):
                found, score = own.guess(some.slice(a, GUESS_ROWS).to_pylist())
                langs += found
                scores.append(score)
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])
        own.forget()
        hand_back()

    return small_batches(docs).withColumn(name, predict.asNondeterministic()("text")), name  # so that it runs once a row, whatever follows


def identify(docs: DataFrame, model: Model | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs with held_out, lang_pred and score; columns of docs with these names give way. Fits a model on docs if there is none."""
    model = model or Model.fit(docs, sample_docs)
    guessed, name = guess(docs.drop("held_out", "lang_pred", "score"), model)
    rest = [c for c in guessed.columns if c != name]
    return guessed.select(*columns(rest), (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), f"{name}.lang_pred", f"{name}.score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = Model.fit(docs.select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
