"""The divergence audit against plain Python on whole small tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from cases import DOCS, edge_docs, edge_rows, no_docs, prose

from hopweave.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=D.TOP):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {a for a, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        whole = Counter()
        for a, s in groups:
            if a == lang:
                whole.update(count[a, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(count[lang, s]) for a, s in groups if a == lang}
        for s, mine in p.items():
            pair = [(sum((mine[t] - o[t]) ** 2 // o[t] for t in kept), x) for x, o in p.items() if x != s]
            term = [((mine[t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] > 0 and mine[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def test_edge_rows(spark):
    rows = edge_rows()
    rows += [(i, t, "fr", s, 1) for i, (t, s) in enumerate([("Été ÉTÉ naïve x1y", "a"), ("été Ünder x_y", "b"), ("Été under-x", "c"), ("naïve", "a"), ("Naïve NAÏVE y", "b")])]
    docs = spark.createDataFrame(rows, DOCS)
    assert rows_of(D.divergence(docs)) == brute(rows)


def test_clashing_columns_and_layout(spark):
    a = rows_of(D.divergence(edge_docs(spark, wide=True)))
    assert a == rows_of(D.divergence(edge_docs(spark).repartition(7))) == brute(edge_rows())


@pytest.mark.parametrize("shard_rows,held,groups", [(50_000, 1_000_000, 100_000), (40, 30, 0)])
def test_shards_of_any_size(spark, monkeypatch, shard_rows, held, groups):
    """Many shards, counts sent on early, and groups joined by shuffle give the same rows; one source has most rows."""
    r = random.Random(3)
    rows = [(i, prose(i % 60, 20), r.choice(["en", "de", None]), r.choice(["hot"] * 6 + ["b", "c", None, "é"]), 1) for i in range(300)]
    monkeypatch.setattr(D, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(D, "HELD_ROWS", held)
    monkeypatch.setattr(D, "GROUPS", groups)
    docs = spark.createDataFrame(rows, DOCS)
    assert rows_of(D.divergence(docs, top=7)) == brute(rows, 7)


def test_counts_sent_on_early_add_up(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD_ROWS", 5)
    batch = pa.record_batch([pa.array(["en"] * 4), pa.array(["a", "a", "b", "b"]), pa.array(["x y", "x x z", "X", ""])], names=["lang", "source", "text"])
    total = Counter()
    docs = Counter()
    for out in D.counted(iter([batch, batch, batch])):
        for row in out.to_pylist():
            total[row["source"], row["term"]] += row["n"]
            docs[row["source"], row["term"]] += row["docs"]
    assert total == {("a", "x"): 9, ("a", "y"): 3, ("a", "z"): 3, ("b", "x"): 3}
    assert docs == {("a", "x"): 6, ("a", "y"): 3, ("a", "z"): 3, ("b", "x"): 3}


def test_nothing_kept_and_nothing_at_all(spark):
    rows = [(1, "a b", "en", "s", 1), (2, "c", "en", "t", 1), (3, None, None, None, None)]
    assert rows_of(D.divergence(spark.createDataFrame(rows, DOCS))) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert rows_of(D.divergence(no_docs(spark))) == []




def test_shares_are_exact_in_spark(spark):
    from pyspark.sql import functions as F

    n, total, kept = 30_000_000_000, 90_000_000_123, 7
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(F.expr(D.share("n")).alias("p")).first()
    assert row.p == 1 + D.SCALE * (n + 1) // (total + kept)
