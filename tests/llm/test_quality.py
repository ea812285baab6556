"""Quality rules against plain Python: counts, exact binomial bounds, cutoffs and verdicts."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from cases import DOCS, edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from hopweave.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
        "n_lines": len(lines),
    }


def ratios(c):
    n = max(c["n_words"], 1)
    return {"symbol_ratio": c["n_symbols"] / n, "dup_line_ratio": c["n_dup_lines"] / max(c["n_lines"], 1), "repeat_ratio": c["n_repeat_words"] / n, "word_length": c["word_chars"] / n}


def brute_cutoffs(labelled):
    """labelled: (stratum, quality, ratios). The loosest passing cutoff that rejects as many bad documents as any."""
    strata = {s for s, _, _ in labelled}
    level = quality.DELTA / (len(strata) * len(quality.GRIDS))
    out = {}
    for s in strata:
        for name, grid in quality.GRIDS.items():
            good = [r[name] for x, q, r in labelled if x == s and q == 1]
            bad = [r[name] for x, q, r in labelled if x == s and q == 0]
            best = None
            for c in grid:
                k, n = sum(x > c for x in good), len(good)
                p = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(quality.RISK) + (n - i) * math.log1p(-quality.RISK)) for i in range(k + 1))
                if p > level:
                    break
                hits = sum(x > c for x in bad)
                if hits and (best is None or hits > best[0]):
                    best = (hits, c)
            if best:
                out[s, name] = best[1]
    return out


def test_query_equals_plain_python(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r["quality"] is not None and r["doc_id"] is not None:
            labels[r["doc_id"]] = min(r["quality"], labels.get(r["doc_id"], 1))
    all_ = {d["doc_id"]: counts(d["text"]) for d in docs}
    limits = brute_cutoffs([(d["lang"] or "", labels[d["doc_id"]], ratios(all_[d["doc_id"]])) for d in docs if d["doc_id"] in labels])
    got = {r["doc_id"]: r for r in quality.op3_quality_rules(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        c, r = all_[d["doc_id"]], got[d["doc_id"]]
        for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
            assert r[k] == c[k], (d["doc_id"], k)
        over = any(v > limits.get((d["lang"] or "", k), math.inf) for k, v in ratios(c).items())
        assert r["kept"] == (not c["base_failed"] and not over)


def test_cutoffs_hold_their_risk(spark):
    """Enough labels give a cutoff where bad and good part, none where they do not, and none with few labels."""
    r = random.Random(5)
    rows = [("large", int(i % 3 > 0), {"symbol_ratio": r.random() * (0.25 if i % 3 else 3), "dup_line_ratio": r.random(), "repeat_ratio": 0.0, "word_length": 6.0}) for i in range(6000)]
    rows += [("small", i % 2, {"symbol_ratio": float(i % 2 == 0) * 3, "dup_line_ratio": 0.0, "repeat_ratio": 0.0, "word_length": 6.0}) for i in range(40)]
    frame = spark.createDataFrame([(s, q, *x.values()) for s, q, x in rows], "stratum string, quality int, symbol_ratio double, dup_line_ratio double, repeat_ratio double, word_length double")
    got = {(x["stratum"], x["ratio"]): x["cutoff"] for x in quality.cutoffs(frame).collect()}
    assert got == brute_cutoffs(rows)
    assert ("large", "symbol_ratio") in got and ("large", "dup_line_ratio") not in got and not any(s == "small" for s, _ in got)


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.05), (1000, 1, 0.005), (5000, 10, 0.005), (100, 30, 0.1), (0, 0, 0.1), (200_000, 700, 0.005)])
def test_binomial_cdf(spark, n, k, p):
    got = spark.range(1).select(quality.binomial_cdf(F.lit(n), F.lit(k), p).alias("p")).first()[0]
    if k >= n * p:
        assert got == 1.0
    else:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        assert math.log(got) == pytest.approx(max(logs) + math.log(math.fsum(math.exp(x - max(logs)) for x in logs)), rel=1e-6)


def test_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0), (7, None, 1), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(edge_docs(spark, wide=True), labels).collect()
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[k] for k in key) for r in got) == sorted(tuple(counts(r[1])[k] for k in key) for r in edge_rows())
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(no_docs(spark), labels).count() == 0
    assert quality.quality_rules(edge_docs(spark), labels).count() == len(edge_rows())


def test_the_strata_are_the_callers_choice(spark):
    docs = spark.createDataFrame([(i, "word " * 3 + " ".join(f"w{i}x{j}" for j in range(60)), "en", f"s{i % 2}", 0) for i in range(20)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = defaultdict(int)
    for r in quality.quality_rules(docs, labels, stratum="source").collect():
        got[r["stratum"]] += 1
    assert got == {"s0": 10, "s1": 10}


def test_strata_with_fewer_labels_are_tested_at_a_wider_risk(spark):
    """The number of good labels alone sets the risk; with too few there is no cutoff."""
    sizes = {"en": 1200, "de": 500, "es": 200, "fr": 90}
    rows = [(s, q, 0.9 if not q and i % 2 else 0.1) for s, n in sizes.items() for q, m in ((1, n), (0, 40)) for i in range(m)]
    frame = spark.createDataFrame(rows, "stratum string, quality int, symbol_ratio double")
    grids = {k: v for k, v in quality.GRIDS.items() if k == "symbol_ratio"}
    level = quality.DELTA / 16
    got = {r["stratum"]: r for r in quality.cutoffs(frame, grids, delta=quality.DELTA / 4).collect()}
    assert {s: r["risk"] for s, r in got.items()} == {"en": 0.005, "de": 0.02, "es": 0.05}
    for s, r in got.items():
        assert (r["cutoff"], r["good_rejected"], r["bad_rejected"]) == (0.8, 0, 20)
        assert (1 - r["risk"]) ** sizes[s] <= level
    assert {r["stratum"] for r in quality.cutoffs(frame, grids, delta=quality.DELTA / 4, wider=()).collect()} == {"en"}


def test_wider_risk_still_fails_a_cutoff_that_costs_too_much(spark):
    rows = [("de", 1, 0.9 if i < 10 else 0.1) for i in range(500)] + [("de", 0, 0.9)] * 40
    frame = spark.createDataFrame(rows, "stratum string, quality int, symbol_ratio double")
    assert quality.cutoffs(frame, {"symbol_ratio": quality.GRIDS["symbol_ratio"]}, delta=quality.DELTA / 16).count() == 0
