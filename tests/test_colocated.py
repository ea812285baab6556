"""Co-located tables: which side of a join is shuffled, and the same results as from other tables."""

import re

import pytest
from pyspark.sql import functions as F

from hopweave.operators import aggregation as A
from hopweave.operators import sampling as S
from hopweave.plans import queries
from hopweave.sources.colocated import colocate


@pytest.fixture()
def by_shuffle(spark):
    """Joins by shuffle, as at a size that no broadcast holds; plans as they are before run time."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanged_columns(df) -> list[str]:
    """The columns of what each exchange of the plan moves."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines, out = plan.split("\n"), []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            out.append(re.sub(r"#\d+L?", "", " ".join(lines[i : i + 2])))
    return out


def test_hops_and_gathers_leave_edges_and_vectors_in_place(by_shuffle, sf):
    g = queries.load(by_shuffle, sf)
    c = colocate(g, 8)
    frontier = S.make_batches(g.nodes, 16).select("batch", "node")
    frontier.write.mode("overwrite").format("noop").save()
    hop = S.sampled_block(c.adjacency, frontier, 0, 5, self_edges=False)
    plan = hop._jdf.queryExecution().executedPlan().toString()
    near = plan[plan.rindex("FileScan") :]
    assert "Bucketed: true" in near and "pos" in near
    moved = exchanged_columns(hop)
    assert not [m for m in moved if "src" in m], moved
    gathered = A.gather(hop.select("batch", F.col("src").alias("node")), c.features)
    assert not [m for m in exchanged_columns(gathered) if "vec" in m]
    plain = S.sampled_block(S.adjacency(g.edges), frontier, 0, 5, self_edges=False)
    assert [m for m in exchanged_columns(A.gather(plain.select("batch", F.col("src").alias("node")), g.features)) if "vec" in m or "src" in m]


def test_same_samples(spark, sf):
    g = queries.load(spark, sf)
    batches = S.make_batches(g.nodes, 16)
    a = S.sample_blocks(colocate(g, 4).adjacency, batches, [5, 3])
    b = S.sample_blocks(g.edges, batches, [5, 3])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
