"""The hash tree against plain Python, its law, its confinement of movement, and slots under repeats."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from cases import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from hopweave.llm import sharding as S


def unit(*parts):
    text = ":".join(str(p) for p in parts if p is not None)
    return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1)


def brute(doc_id, tree):
    def pick(level, weights):
        return min((-math.log(unit(S.SEED, level, i, doc_id)) / w, i) for i, w in weights.items() if w > 0)[1]

    def total(shards, of):
        c = Counter()
        for s in shards:
            c[getattr(s, of)] += s.weight
        return c

    region = pick("region", total(tree, "region"))
    rack = pick("rack", total([s for s in tree if s.region == region], "rack"))
    return pick("shard", total([s for s in tree if s.rack == rack], "shard"))


def shards(spark, ids, tree):
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id: r.shard for r in docs.select("doc_id", S.shard_of(F.col("doc_id"), tree).alias("shard")).collect()}


TREES = [S.laid_out(40), S.laid_out(7, 2, 2), S.with_shard(S.laid_out(40), 2.5), S.reweighted(S.laid_out(16), 3, 0.0), S.laid_out(1)]


@pytest.mark.parametrize("tree", TREES, ids=range(len(TREES)))
def test_descent_equals_plain_python(spark, tree):
    got = shards(spark, [*range(300), None], tree)
    assert got == {i: brute(i, tree) for i in [*range(300), None]}


def test_shares_follow_weights(spark):
    tree = S.reweighted(S.reweighted(S.laid_out(16), 5, 3.0), 9, 0.5)
    n, total = 40_000, sum(s.weight for s in tree)
    got = Counter(shards(spark, range(n), tree).values())
    for s in tree:
        want = n * s.weight / total
        assert abs(got[s.shard] - want) < 5 * math.sqrt(want)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = S.laid_out(40)
    for _ in range(3):  # at any number of added shards
        grown = S.with_shard(tree)
        new = grown[-1].shard
        before, after = shards(spark, range(8000), tree), shards(spark, range(8000), grown)
        moved = [i for i in before if before[i] != after[i]]
        assert moved and all(after[i] == new for i in moved)
        assert abs(len(moved) - 8000 / len(grown)) < 5 * math.sqrt(8000 / len(grown))
        tree = grown


@pytest.mark.parametrize("weight", [0.0, 0.5, 4.0])
def test_movement_stays_in_subtrees_whose_weights_change(spark, weight):
    tree = S.laid_out(40)
    where, changed = {s.shard: s for s in tree}, tree[13]
    before, after = shards(spark, range(8000), tree), shards(spark, range(8000), S.reweighted(tree, 13, weight))
    moved = [(where[before[i]], where[after[i]]) for i in before if before[i] != after[i]]
    assert moved
    for a, b in moved:
        if a.region != b.region:
            assert changed.region in (a.region, b.region)
        elif a.rack != b.rack:
            assert a.region == changed.region and changed.rack in (a.rack, b.rack)
        else:
            assert a.rack == changed.rack and changed.shard in (a.shard, b.shard)


def test_a_tree_needs_weight():
    with pytest.raises(ValueError):
        S.shard_of(F.lit(1), S.reweighted(S.laid_out(1), 0, 0.0))


def test_place_reads_bytes_and_gives_way(spark):
    docs = edge_docs(spark, wide=True)
    placed = S.place(docs)
    assert set(placed.columns) == {*docs.columns, "text_crc32", "shard"}
    got = Counter((r.doc_id, r.text, r["size"], r.text_crc32, r.shard) for r in placed.collect())
    tree = S.laid_out()
    want = Counter((i, t, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), brute(i, tree)) for i, t, *_ in edge_rows())
    assert got == want


def test_slots_are_gapless_whatever_repeats(spark):
    """One row in 90 % of all, one id with many texts, and a run that is cut into pieces for its output."""
    rows = [(5, 1, 7)] * 9000 + [(5, i, 7) for i in range(500)] + [(None, 1, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, size long, shard int")
    for bucket_rows, run_rows in ((50_000, 10_000), (50, 400)):
        got = S.numbered(df, bucket_rows=bucket_rows, run_rows=run_rows).collect()
        assert Counter((r.doc_id, r["size"], r.shard) for r in got) == Counter(rows)
        for s in (0, 1, 2, 7):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    a = sorted((r.shard, r.slot, str(r.doc_id), r["size"]) for r in S.numbered(df).collect())
    assert a == sorted((r.shard, r.slot, str(r.doc_id), r["size"]) for r in S.numbered(df.repartition(5), bucket_rows=50, run_rows=400).collect())


def test_empty_table(spark):
    assert S.numbered(S.place(no_docs(spark)).select("doc_id", "size", "shard")).collect() == []


def test_shards_are_written_once_each(spark, tmp_path):
    docs = edge_docs(spark)
    S.write_shards(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((r.doc_id, r.text, r.shard) for r in S.place(docs).collect())
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == sorted({f"shard={r.shard}" for r in back.collect()})


def test_query(spark, sf):
    got = S.op13_sharding(spark, sf)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "grown_shard int", "slot bigint"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) for r in rows)
