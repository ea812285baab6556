"""The fitted operators: held-out accuracy, the segment search against brute force, and rows that teach nothing."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from cases import edge_docs, edge_rows, fold, no_docs

from hopweave.llm import language, toxicity
from hopweave.llm.common import hash_word, mix


def test_language_held_out_accuracy(spark, sf):
    got = {r["doc_id"]: r for r in language.op6_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [d for d in docs if got[d["doc_id"]]["held_out"] and d["lang"] and d["text"] and any(c.isalpha() for c in d["text"])]
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.9


def test_language_backs_off_to_shorter_grams(spark):
    texts = [(i, "strasse wasser haus garten" if i % 2 else "street water house garden", "de" if i % 2 else "en") for i in range(60)]
    model = language.Model.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    assert model.predict("Strasse Wasser")[0] == "de" and model.predict("WATER street")[0] == "en"
    assert model.known(0, "gartenhaus") is None and model.predict("gartenhaus")[0] == "de"
    assert model.predict(None) == ("und", 0.0) == model.predict("12 !!")
    word = model.score("strass")
    longest = [x for g in language.grams("strass", 5) if (x := model.known(5, g)) is not None]
    assert longest and np.allclose(word, np.mean(longest, axis=0))


def test_language_equals_plain_counting(spark, sf):
    """Every prediction and score against dictionaries of strings, with a sample that takes all training rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = [(10_001, "Straße für Übung", "de"), (10_002, "xyzzy qwxk", None), (10_009, "हिन्दी भाषा", "hi"), (10_010, "हिन्दी भाषा", "hi"), (10_011, "हिन्दी भाषा", "hi"), (10_004, "हिन्दी", None), (10_005, "\u00b2 \u00bd \u2460 12", None), (10_006, "ΟΔΟΣ οδος", None), (10_007, "", "en")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = docs.collect()
    assert language.MOST_LANGS > 5 and len(rows) < 2500
    got = {r["doc_id"]: r for r in language.identify(docs.select("doc_id", "text"), language.Model.fit(docs)).collect()}

    def words(text):
        out, now = [], ""
        for c in (text or "").lower():
            if unicodedata.category(c)[0] in "LM":
                now += c
            else:
                out, now = out + [now] if now else out, ""
        return out + [now] if now else out

    counts = {}
    for r in rows:
        if r["lang"] and r["text"] is not None and fold(r["doc_id"], 3) != 1:
            for w in words(r["text"]):
                for n, g in [(0, w)] + [(n, g) for n in range(1, 6) for g in language.grams(w, n)]:
                    counts.setdefault((n, r["lang"]), Counter())[g] += 1
    langs = sorted({lang for _, lang in counts})
    every = {n: len({g for lang in langs for g in counts.get((n, lang), ())}) for n in range(6)}

    def score(n, g):
        c = [counts.get((n, lang), Counter()) for lang in langs]
        return np.log([(x[g] + 0.1) / (x.total() + 0.1 * every[n]) for x in c]) if any(g in x for x in c) else None

    memory = {}

    def word_score(w):
        if w not in memory:
            out = score(0, w)
            for n in range(5, 0, -1):
                if out is None and (found := [s for g in language.grams(w, n) if (s := score(n, g)) is not None]):
                    out = np.mean(found, axis=0)
            memory[w] = np.zeros(len(langs)) if out is None else out
        return memory[w]

    for r in rows:
        own = got[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
            continue
        sums = sum(word_score(w) for w in words(r["text"]))
        assert own["lang_pred"] == langs[int(np.argmax(np.round(sums, 6)))], r["doc_id"]
        assert own["score"] == pytest.approx(1 / np.exp(sums - sums.max()).sum(), abs=1e-3)
    assert got[10_004]["lang_pred"] == "hi" and got[10_005]["lang_pred"] == "und"


def test_language_long_texts_are_cut_between_words(spark):
    texts = [(i, "strasse wasser haus garten" if i % 2 else "street water house garden", "de" if i % 2 else "en") for i in range(60)]
    model = language.Model.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    text = "street wasser haus " * 500
    whole = model.guess([text, None, "haus"])
    cut = [(rows, parts) for rows, parts in language.runs([text, None, "haus"], 50)]
    assert "".join(p for _, parts in cut for p in parts) == text + "haus" and len(cut) > 100
    assert all(w in ("street", "wasser", "haus") for _, parts in cut for p in parts for w in p.split())
    language.RUN, kept = 50, language.RUN
    try:
        again = model.guess([text, None, "haus"])
    finally:
        language.RUN = kept
    assert whole[0] == again[0] == ["de", "und", "de"] and np.allclose(whole[1], again[1])


def test_language_keeps_columns_with_its_names(spark):
    docs = spark.createDataFrame([(1, "some words here", 7.0, "x", "en")], "doc_id long, text string, `a.b` double, _guess string, lang string")
    guessed, name = language.guess(docs)
    assert name not in docs.columns and [tuple(r)[:4] for r in guessed.collect()] == [(1, "some words here", 7.0, "x")]


def test_language_edge_rows(spark):
    got = language.identify(edge_docs(spark, wide=True))
    assert got.columns.count("score") == 1
    rows = got.collect()
    assert len(rows) == len(edge_rows())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if not any(c.isalpha() for c in r["text"] or ""))
    assert language.identify(no_docs(spark)).count() == 0


def brute_segments(x):
    """Maximal segments by their recursive definition: the best segment, then those of what is left and right of it."""
    if not len(x):
        return []
    best, at = 0.0, None
    for i in range(len(x)):
        s = 0.0
        for j in range(i, len(x)):
            s += x[j]
            if s > best + 1e-12 or (at and abs(s - best) <= 1e-12 and j - i + 1 < at[1] - at[0]):
                best, at = s, (i, j + 1)
    if at is None:
        return []
    a, b = at
    left = brute_segments(x[:a])
    right = [(i + b, j + b, s) for i, j, s in brute_segments(x[b:])]
    return [*left, (a, b, best), *right]


def test_segments_equal_their_definition():
    r = random.Random(3)
    for _ in range(300):
        x = [r.uniform(-1.2, 1) for _ in range(r.randrange(14))]
        got, want = toxicity.segments(x), brute_segments(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own_pieces(word):
    return [word[:k] for k in toxicity.STEMS if len(word) >= k] + [word + "$"]


def own_best(words, evidence, drift):
    """The best segment's score, by Kadane's rule."""
    best = now = 0.0
    for w in words:
        held = [evidence[p] for p in own_pieces(w)[::-1] if p in evidence]
        now = max(0.0, now + (max(held, key=lambda x: x[1])[0] if held else -drift))
        best = max(best, now)
    return best


def test_toxicity_fit_equals_plain_counting(spark, sf):
    """Log-odds, lambda, K and the curve against loops over strings."""
    from pathlib import Path

    sf = str(Path(sf).parent / "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    worst = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and fold(r["doc_id"], 4) != 2:
            worst[r["doc_id"]] = max(r["toxic"], worst.get(r["doc_id"], 0))
    rows = {}
    for r in docs.collect():
        if r["doc_id"] in worst and r["text"] is not None:
            rows.setdefault(r["text"], []).append((r["doc_id"], worst[r["doc_id"]]))
    rows = [(min(i for i, _ in v), max(t for _, t in v), WORDS.findall(text.translate(LOWER))) for text, v in rows.items()]
    occ, held, n, t = [Counter(), Counter()], [Counter(), Counter()], [0, 0], [0, 0]
    for i, y, words in rows:
        if fold(f"part{i}", 4) == 0:
            continue
        c = Counter(p for w in words for p in own_pieces(w))
        occ[y].update(c)
        held[y].update(c.keys())
        n[y] += len(words)
        t[y] += 1

    def odds(a, b, all_a, all_b, prior):
        alpha = prior * (a + b) / (all_a + all_b)
        d = math.log((a + alpha) / (all_a + prior - a - alpha)) - math.log((b + alpha) / (all_b + prior - b - alpha))
        return d, d / math.sqrt(1 / (a + alpha) + 1 / (b + alpha))

    evidence = {}
    for p, d1 in held[1].items():
        d, z = odds(occ[1][p], occ[0][p], n[1], n[0], toxicity.PRIOR)
        e, ze = odds(d1, held[0][p], t[1], t[0], toxicity.PRIOR_DOCS)
        if d1 > 1 and d > 0 and e > 0 and z > toxicity.LEAST_Z and ze > toxicity.LEAST_Z_DOCS:
            evidence[p] = d * min(z, ze) ** 2 / (min(z, ze) ** 2 + 9), min(z, ze)
    assert evidence

    def key(p):
        return int(mix(np.array([hash_word(p[:-1])], np.uint64) ^ np.uint64(0xA11))[0]) if p.endswith("$") else hash_word(p)

    want = {key(p): v for p, v in evidence.items()}
    assert dict(zip(model.keys.tolist(), model.scores.tolist())) == {k: pytest.approx(v[0]) for k, v in want.items()}
    calm = Counter(w for _, y, words in rows if y == 0 for w in words)
    total, used = 0.0, set()
    for w, times in calm.items():
        own = [(evidence[p], p) for p in own_pieces(w)[::-1] if p in evidence]
        chosen = max(own, key=lambda x: x[0][1]) if own else None
        total += times * math.exp(model.lam * (chosen[0][0] if chosen else -model.drift))
        used |= {chosen[1]} if chosen else set()
    rare = sum(1e-9 * math.exp(min(model.lam * v[0], 600)) for p, v in evidence.items() if p not in used)  # pieces that no calm text has
    assert total / calm.total() + rare == pytest.approx(1, abs=1e-6)
    best = [(own_best(words, evidence, model.drift), len(words)) for _, y, words in rows if y == 0]
    terms = [m * math.exp(-model.lam * b) for b, m in best if b > 0]
    assert model.k == pytest.approx(min(1.0, max(1e-6, 1 / np.mean(terms))), rel=1e-6)
    # the curve is where the regularised likelihood has no slope
    x, y = [], []
    for i, toxic, words in rows:
        if fold(f"part{i}", 4) == 0:
            line = []
            for w in words:
                own = [evidence[p] for p in own_pieces(w)[::-1] if p in evidence]
                line.append(max(own, key=lambda v: v[1])[0] if own else -model.drift)
            x.append(math.log1p(model.evidence(toxicity.segments(line), len(words))))
            y.append(toxic)
    a, b = model.curve
    slope = np.array(y) - 1 / (1 + np.exp(-(a + b * np.array(x))))
    assert slope.sum() - 1e-2 * a == pytest.approx(0, abs=1e-3) and (slope * np.array(x)).sum() - 1e-2 * b == pytest.approx(0, abs=1e-2)


def test_evidence_of_sums_is_bounded_by_its_law():
    """On random scores with the fitted law, evidence over -log(0.05) is as rare as it says."""
    r = np.random.default_rng(5)
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.1, lam=1.0, k=0.01)
    over = 0
    for _ in range(2000):  # Poisson many segments of exponential scores: mean K n exp(-x) over x
        found = [(0, 1, float(s)) for s in r.exponential(1.0, r.poisson(0.01 * 1000))]
        over += model.evidence(found, 1000) > -math.log(0.05)
    assert over / 2000 < 0.06


def test_toxicity_held_out_ranking(spark, sf):
    from pathlib import Path

    sf = str(Path(sf).parent / "sf0.1")
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    assert all(r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    known = [(r["toxic"], got[r["doc_id"]]["score"], lang[r["doc_id"]]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None and r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    for which, floor, alarms in (("en", 0.9, 0.01), ("de", 0.9, 0.02), ("fr", 0.95, 0.05), ("es", 0.95, 0.07), (None, 0.95, 0.02)):
        bad, good = [[s for t, s, l in known if t == k and which in (None, l)] for k in (1, 0)]
        assert np.mean([s >= 0.3 for s in bad]) >= floor, which
        assert np.mean([s >= 0.3 for s in good]) <= alarms, which
        assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) >= 0.93, which


def test_toxicity_without_lessons(spark):
    docs = edge_docs(spark, wide=True)
    for labels, score in (([], 0.0), ([(7, None), (None, 1)], 0.0), ([(2, 1), (3, 1), (4, 1)], 1.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        rows = toxicity.score_toxicity(docs, model).collect()
        assert len(rows) == len(edge_rows())
        assert all(r["score"] == pytest.approx(score, abs=1e-3) for r in rows)
    assert toxicity.score_toxicity(no_docs(spark), model).count() == 0


def test_every_segment_of_a_long_text_counts():
    """Evidence against the plain sum over every r, with hundreds of segments: more of them are more evidence."""
    model, level, last = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.1, lam=1.0, k=0.01), math.log(0.01 * 100_000), 0.0
    for m in (1, 40, 60, 200, 500):
        found = [(i, i + 1, level + 2 + (i * 37 % 11) / 10) for i in range(m)]
        best = sorted((s - level for *_, s in found), reverse=True)
        sums = [sum(best[:r]) - (r - 1) * math.log(sum(best[:r])) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2) for r in range(2, m + 1) if sum(best[:r]) > r]
        want = max([-math.log(-math.expm1(-math.exp(-best[0]))) - math.log(2), *sums])
        got = model.evidence(found, 100_000)
        assert got == pytest.approx(want) and got > last
        last = got


def test_known_words_are_those_looked_up_anew(monkeypatch):
    """Words that recur over texts, and a store that is emptied, give what each word gives by itself."""
    r = np.random.default_rng(2)
    vocabulary = [f"stem{i}" + "x" * (i % 5) for i in range(60)]
    data, starts, ends = _words(vocabulary)
    keys = toxicity.word_pieces(data, starts, ends)[::3].ravel()
    keys = np.unique(keys[keys != 0])
    model = toxicity.Model(keys, r.random(len(keys)), r.random(len(keys)), 0.1)
    alone = dict(zip(vocabulary, model.best_pieces(data, starts, ends).tolist()))
    for most in (1_000_000, 10):
        monkeypatch.setattr(toxicity, "KNOWN_WORDS", most)
        for _ in range(5):
            some = [vocabulary[i] for i in r.integers(0, 60, 30)]
            assert model.chosen(*_words(some)).tolist() == [alone[w] for w in some]


def _words(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return data, ends - [len(w) for w in words], ends
