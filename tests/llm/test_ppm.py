"""PPM scores against a byte-by-byte model in dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from cases import edge_docs, edge_rows, fold, no_docs

from hopweave.llm import ppm

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, order=ppm.ORDER):
    """(n_tokens, n_known, N, base, score) of each row."""
    train = [t for i, t in rows if fold(i, 5) != 1]
    words = Counter(w for t in train for w in [*WORD.findall(lower(t)), None])
    n, v = sum(words.values()), len(words)
    contexts = [defaultdict(Counter) for _ in range(order + 1)]

    def symbols(text):
        return [ppm.PAD] * order + list(lower(text).encode()) + [ppm.END]

    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                contexts[k][tuple(s[i - k : i])][s[i]] += 1
    out = []
    for _, t in rows:
        tokens = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        s, score = symbols(t), 0.0
        for i in range(order, len(s)):
            gone: set[int] = set()
            for k in range(order, -1, -1):
                seen = contexts[k].get(tuple(s[i - k : i]), {})
                own = {x: c for x, c in seen.items() if x not in gone}
                if own:
                    t_, q = sum(own.values()), len(own)
                    if s[i] in own:
                        score += math.log10(own[s[i]] / (t_ + q))
                        break
                    score += math.log10(q / (t_ + q))
                gone |= seen.keys()
            else:
                score -= math.log10(ppm.SYMBOLS - len(gone))
        out.append((len(tokens), sum(words[w] > 0 for w in tokens), n, base, score))
    return out


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_scores_equal_the_plain_model(spark, order):
    rows = [(i, f"{'ab' * (i % 7)} the cat{i % 5} sat, ON mat {i * 37 % 11}" if i % 9 else None) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.ppm_scores(docs, order=order, block_bytes=300).collect()}
    for (i, _), (n_tokens, n_known, n, base, score) in zip(rows, brute(rows, order), strict=True):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] not in (6, 12)]
    docs = edge_docs(spark, wide=True).where("doc_id is null or doc_id not in (6, 12)")
    got = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in ppm.ppm_scores(docs).collect())
    assert got == sorted((a, b, round(c, 5), round(d, 5)) for a, b, _, c, d in brute(rows))


def test_long_text_and_empty_table(spark):
    assert ppm.ppm_scores(edge_docs(spark)).count() == len(edge_rows())
    assert ppm.ppm_scores(no_docs(spark)).count() == 0


def test_rows_without_ids_spread_over_blocks(spark):
    rows = [(None, f"word{i:04d}") for i in range(400)]  # of one length
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_tokens"], round(r["score"], 6)) for r in ppm.ppm_scores(docs, order=2, block_bytes=200).collect())
    assert got == sorted((a, round(e, 6)) for a, _, _, _, e in brute(rows, 2))


def test_held_out_texts_are_predicted(spark, sf):
    """The model's bits a byte on held-out texts are well below eight."""
    scored = ppm.op2_lm_scoring(spark, sf).where("held_out").selectExpr("-sum(score) / log10(2) / sum(n_bytes + 1)").first()[0]
    assert 0 < scored < 4


def test_deep_subtrees_give_the_same_lengths(spark):
    """Subtrees dealt by three context bytes, all of them, some of them or none."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["the", "then", "there", "ab", "abb"]) + str(r.randrange(9)) for _ in range(12))) for i in range(60)], "doc_id long, text string")
    found = ppm.block_keys(docs.selectExpr("0 AS block", "doc_id % 3 <> 0 AS train", "text"), 4).where(f"kind = {ppm.GRAM}").groupBy("key").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    values = [{row["key"]: row["value"] for row in ppm.gram_lengths(found, 4, subtree_rows=s).collect()} for s in (0, 20, 10**9)]
    assert values[0].keys() == values[1].keys() == values[2].keys()
    for k, v in values[2].items():
        assert values[0][k] == pytest.approx(v) and values[1][k] == pytest.approx(v)


def test_one_text_in_most_rows(spark):
    """A text in 90 % of the rows, in many blocks: each key's counts are added up before they meet."""
    rows = [(i, "the cat sat on the mat" if i % 10 else f"other words {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.ppm_scores(docs, order=2, block_bytes=200).collect()}
    for (i, _), (n_tokens, n_known, n, base, score) in zip(rows, brute(rows, 2), strict=True):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n_tokens, n_known, n)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] == pytest.approx(score)
