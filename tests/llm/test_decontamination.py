"""Decontamination against plain Python on edge rows; the whole query is tested against SQL in test_sql.py."""

import re

from cases import edge_docs, edge_rows, no_docs, prose

from hopweave.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [(1, prose(2, 300)), (2, "one two three four"), (3, "ÀÉ naïve CAFÉ"), (4, None), (5, "  ... "), (None, prose(3, 30)), (6, "word " * 12), (7, "never seen anywhere in the texts of this test at all")]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, n=10):
    w, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        b = words(t)
        for i in range(max(1, len(b) - n + 1)) if b else ():
            g = b[i : i + n]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    items.add(item)
    return len(w), len(hit), ",".join(sorted(str(x) for x in items if x is not None)), bool(hit)


def test_edge_rows(spark):
    rows = [r for r in edge_rows() if r[0] not in (6,)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = edge_docs(spark, wide=True).where("doc_id is null or doc_id <> 6")
    got = D.decontaminate(docs, items).collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got) == sorted(brute(r[1]) for r in rows)
    assert {(r["score"], r["key"], r["size"], r["point"]) for r in got} == {(0.5, "k", "s", "p")}
    kept = D.remove_documents(docs, items)
    clash = docs.selectExpr("*", "7 as n_hit", "'mine' as _leak_doc_id", "'d' as _key", "'x' as `dotted.name`")
    again = D.remove_documents(clash, items)
    assert again.columns == clash.columns and {(r["n_words"], r["items"], r["n_hit"], r["_leak_doc_id"], r["_key"], r["dotted.name"]) for r in again.collect()} == {(1, "i", 7, "mine", "d", "x")}
    assert kept.columns == docs.columns and kept.count() == sum(not brute(r[1])[3] for r in rows)


def test_by_shuffle_beyond_the_broadcast_bound(spark):
    windows, members = D.prepared(spark.createDataFrame(ITEMS, "item_id long, text string"), 10)
    near = D.find_hits(edge_docs(spark), windows).orderBy("doc_id", "digest", "start", "end").collect()
    far = D.find_hits(edge_docs(spark), windows, broadcast_bytes=0).orderBy("doc_id", "digest", "start", "end").collect()
    assert near == far and near


def test_one_window_in_most_rows_and_items(spark):
    """A passage that 90 % of the documents hold many times and 300 items share: hits carry no item lists, places are salted."""
    passage = prose(5, 12)
    docs = spark.createDataFrame([(i, f"{passage} " * 6 if i % 10 else prose(100 + i, 40)) for i in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(i, passage) for i in range(300)], "item_id long, text string")
    windows, members = D.prepared(items, 10)
    assert windows.count() == 3 and members.count() == 900
    hits = D.find_hits(docs, windows, broadcast_bytes=0)
    assert hits.columns == ["doc_id", "digest", "start", "end", "win"] and hits.count() == 360 * 6 * 3
    a, b = (sorted(map(tuple, D.decontaminate(docs, items, **k).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect())) for k in ({}, {"broadcast_bytes": 0}))
    assert a == b and {r[3] for r in a} == {0, 300} and {r[2] for r in a if r[5]} == {72}


def test_whole_table_by_shuffle(spark, sf, duck):
    """Every document of the table, beyond the bound, against the SQL of the query."""
    from compare import assert_same
    from pyspark.sql import functions as F

    got = D.decontaminate(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet"), broadcast_bytes=0)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")
    assert_same(got.toPandas(), duck.execute(D.OP5_SQL).df())


def test_spans_go_and_other_words_stay(spark):
    docs = spark.createDataFrame([(1, "Keep this, " + "word " * 12 + "and that."), (2, "Left AS it is.")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in D.remove_spans(docs, items).collect()}
    assert got == {1: "keep this and that", 2: "Left AS it is."}


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(edge_docs(spark), items).where("contaminated").count() == 0
    assert D.decontaminate(no_docs(spark), items).count() == 0
