"""Steps whose tasks and driver must not take more as tables grow: how edges are dealt over tasks, and what is never broadcast."""

import random
import re
from collections import defaultdict
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq

from hopweave.operators import ingest as I
from hopweave.operators import owners as O
from hopweave.sources import graphs as G
from hopweave.sources.colocated import bucketed
from hopweave.sources.kept import kept


def plan_of(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def some_pairs(n=60, edges=400, seed=3):
    r = random.Random(seed)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(edges)]
    return pairs + pairs[:50] + [(b, a) for a, b in pairs[:30]] + [(4, 4)]


def test_tasks_follow_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert I.tasks_for(spark, 0) == I.tasks_for(spark, I.TASK_ROWS) == cores
    assert I.tasks_for(spark, 100 * I.TASK_ROWS) == 100 and I.tasks_for(spark, 100 * I.TASK_ROWS + 1) == 101
    assert I.tasks_for(spark, 1000, 10) == 100


def test_metis_rows_deals_edges_over_counted_tasks(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(G, "tasks_for", lambda _, rows: asked.append(rows) or 37, raising=False)
    pairs, nodes = some_pairs(), spark.range(70).withColumnRenamed("id", "node")
    rows = G.metis_rows(edges_of(spark, pairs), nodes)
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    top = max(map(len, near.values()))
    assert {r.node: r.line for r in rows.collect()} == {i: " ".join([str(10 * len(near[i]) // top), *(str(x + 1) for x in sorted(near[i]))]) for i in range(70)}
    assert asked == [2 * len(pairs)]
    assert re.search(r"hashpartitioning\(dst#\d+L?, 37\)", plan_of(rows))
    none = G.metis_rows(edges_of(spark, [(1, 1)]), nodes.where("node < 3"))
    assert {r.node: r.line for r in none.collect()} == {0: "0", 1: "0", 2: "0"}


def test_purchase_edges_deals_lines_over_counted_tasks(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(G, "tasks_for", lambda _, rows: asked.append(rows) or 37, raising=False)
    r = random.Random(5)
    lines = [(r.randrange(20), r.randrange(6), r.choice([None, *range(9)])) for _ in range(300)] + [(None, 1, 2), (None, 2, 3), (5, None, 1)]
    order, number, part = zip(*lines)
    pq.write_table(pa.table({"l_orderkey": pa.array(order, pa.int64()), "l_linenumber": pa.array(number, pa.int32()), "l_partkey": pa.array(part, pa.int64())}), tmp_path / "lineitem.parquet")
    want = set()
    for o, a, x in lines:
        for p, b, y in lines:
            if None not in (o, a, x, b, y) and o == p and abs(a - b) == 1 and x != y:
                want.add((x, y))
    found = G.purchase_edges(spark, str(tmp_path))
    got = [(e.src, e.dst) for e in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert asked == [len(lines)]
    plan = plan_of(found)
    assert re.search(r"hashpartitioning\(x#\d+L?, y#\d+L?, 37\)", plan) and "BroadcastHashJoin" not in plan


def broadcast_keys(df):
    """The keys of each join by broadcast."""
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan_of(df))]


def test_rows_of_nodes_are_not_broadcast(spark):
    pairs = some_pairs()
    edges, owners = edges_of(spark, pairs), spark.createDataFrame([(i, i % 4) for i in range(60)], "node bigint, part int")
    assert all(keys == ["want"] for keys in broadcast_keys(O.label_propagation(edges, owners)))  # what an owner holds: a row each
    assert all(keys == ["want"] for keys in broadcast_keys(O.gains(O.neighbours_of(edges), owners, 4, 16, 8)))
    seen = []

    def keep(df):
        seen.extend(broadcast_keys(df))
        return kept(df)

    found, _ = O.balanced_partition(edges, owners, most_rounds=3, keep=keep, measure=False)
    assert seen and all(keys == ["want"] for keys in seen + broadcast_keys(found))
    near = [tuple(x) for x in O.neighbours_of(edges).collect()]
    assert sorted(near) == sorted((a, b, sum({x, y} == {a, b} for x, y in pairs)) for a, b, _ in near) and len(near) == len({(a, b) for x, y in pairs if x != y for a, b in ((x, y), (y, x))})


def test_laid_out_edges_give_the_same_owners(spark):
    edges, owners = edges_of(spark, some_pairs()), spark.createDataFrame([(i, i % 4) for i in range(60)], "node bigint, part int")
    a, cuts = O.balanced_partition(edges, owners, most_rounds=3, keep=kept)
    b, more = O.balanced_partition(edges, owners, most_rounds=3, keep=kept, lay=partial(bucketed, name="near"))
    assert cuts == more and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
