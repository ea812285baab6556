"""Owner policies and what they cost: cuts, halos, movement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import TASK_ROWS, ranked_down, tasks_for


def modulo(nodes: DataFrame, parts: int = 4) -> DataFrame:
    return nodes.select("node", F.pmod("node", F.lit(parts)).cast("int").alias("part"))


def contiguous(nodes: DataFrame, parts: int = 4) -> DataFrame:
    """Equal ranges of dense ids."""
    n = nodes.agg((F.max("node") + 1).alias("_n"))
    return nodes.crossJoin(F.broadcast(n)).select("node", F.least(F.floor(F.col("node") * parts / F.col("_n")), F.lit(parts - 1)).cast("int").alias("part"))


def with_owners(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """edges with src_part and dst_part."""
    s = owners.select(F.col("node").alias("src"), F.col("part").alias("src_part"))
    d = owners.select(F.col("node").alias("dst"), F.col("part").alias("dst_part"))
    return edges.join(s, "src").join(d, "dst")


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle: rows of nodes, which a plan would collect in the driver and broadcast up to 10 MB of their files,
    many times that in memory, at each join of each round."""
    return df.hint("merge")


def source_counts(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """dst, src_part, n: in-edges of each node by their sources' owners."""
    s = owners.select(F.col("node").alias("src"), F.col("part").alias("src_part"))
    return edges.join(by_shuffle(s), "src").groupBy("dst", "src_part").agg(F.count("*").alias("n"))


def majority(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """node, part: the owner of most of a node's in-edges, the smallest of equals; nodes without in-edges keep theirs."""
    best = source_counts(edges, owners).groupBy("dst").agg(F.max(F.struct(F.col("n"), (-F.col("src_part")).alias("p"))).alias("m"))
    voted = best.select(F.col("dst").alias("node"), (-F.col("m.p")).alias("_p"))
    return owners.join(voted, "node", "left").select("node", F.coalesce("_p", "part").cast("int").alias("part"))


def label_propagation(edges: DataFrame, owners: DataFrame, parts: int = 4, slack: float = 1.1) -> DataFrame:
    """One pass towards majority owners, in order of votes, while an owner has room: at most slack * N / parts nodes each."""
    best = source_counts(edges, owners).groupBy("dst").agg(F.max(F.struct(F.col("n"), (-F.col("src_part")).alias("p"))).alias("m"))
    votes = owners.join(by_shuffle(best.select(F.col("dst").alias("node"), F.col("m.n").alias("n"), (-F.col("m.p")).alias("want"))), "node", "left")
    votes = votes.withColumn("want", F.coalesce("want", "part"))
    stay = votes.where("want = part").groupBy(F.col("part").alias("want")).agg(F.count("*").alias("held"))
    total = owners.agg((F.count("*") * F.lit(slack / parts)).alias("cap"))
    movers = ranked_down(votes.where("want <> part").select("node", "n", "want"), ["want"], "n").withColumnRenamed("_r", "r")
    moved = movers.join(stay, "want", "left").crossJoin(F.broadcast(total)).where(F.col("r") + F.coalesce("held", F.lit(0)) <= F.col("cap")).select("node", F.col("want").alias("_w"))
    return owners.join(by_shuffle(moved), "node", "left").select("node", F.coalesce("_w", "part").cast("int").alias("part"))


def neighbours_of(edges: DataFrame) -> DataFrame:
    """node, near, n: both directions of all edges but loops, repeats counted, of both directions alike."""
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
    return pairs.select(F.explode(ends).alias("e"), "n").select("e.node", "e.near", "n")


def gains(near: DataFrame, owners: DataFrame, parts: int, cap: int, buckets: int) -> DataFrame:
    """node, part, want, gain: of each node that would cut fewer edges with another owner that has room, its best such owner (the
    smallest of equals) and how many fewer. Owners go to near's edges by near, in `buckets` tasks."""
    held = owners.groupBy("part").agg(F.count("*").alias("held"))
    all_parts = owners.sparkSession.range(parts).select(F.col("id").cast("int").alias("want"))
    room = all_parts.join(held.withColumnRenamed("part", "want"), "want", "left").where(F.coalesce("held", F.lit(0)) < cap).select("want", F.lit(True).alias("room"))
    there = owners.select(F.col("node").alias("near"), F.col("part").alias("want")).repartition(buckets, "near")
    counts = near.join(there.hint("shuffle_hash"), "near").groupBy("node", "want").agg(F.sum("n").alias("k"))
    counts = counts.join(by_shuffle(owners), "node").join(F.broadcast(room), "want", "left")  # a row an owner
    own = F.max(F.when(F.col("want") == F.col("part"), F.col("k")))
    best = F.max(F.when((F.col("want") != F.col("part")) & F.col("room"), F.struct("k", (-F.col("want")).alias("w"))))
    votes = counts.groupBy("node", "part").agg(F.coalesce(own, F.lit(0)).alias("own"), best.alias("best")).where("best is not null")
    return votes.select("node", "part", (-F.col("best.w")).alias("want"), (F.col("best.k") - F.col("own")).alias("gain")).where("gain > 0")


def balanced_partition(edges: DataFrame, owners: DataFrame, parts: int = 4, slack: float = 1.1, most_rounds: int = 100, keep=None, measure: bool = True, lay=None) -> tuple[DataFrame, list[int]]:
    """(owners, cuts): size-constrained label propagation to a fixed point, and how many edges each round still had cut (a job more
    a round; none with measure=False).

    In each round every node that would cut fewer edges elsewhere asks for its best owner with room. Of nodes that are neighbours
    only the one with the larger gain moves, so every gain is exact and the cut falls by their sum; where more ask than an owner
    has room for, at most slack * N / parts nodes, those of the largest gains get in, by prefix ranks. It ends when no move helps,
    which it must, as the cut is a falling whole number. keep(df) writes what is read again; lay(df, keys, buckets) writes it in
    buckets by keys: the edges, to which each round sends the nodes' rows. Edges are counted first, for the number of buckets.
    """
    keep = keep or (lambda df: df)
    buckets = tasks_for(edges.sparkSession, 2 * edges.count(), 4 * TASK_ROWS)
    near, now = neighbours_of(edges), keep(owners.select("node", "part"))
    near = lay(near, ["near"], buckets) if lay else keep(near)
    cap, cuts = int(now.count() * slack / parts), []
    for at in range(most_rounds):
        cut = 0 if not measure else near.join(now.select("node", F.col("part").alias("a")), "node").join(now.select(F.col("node").alias("near"), F.col("part").alias("b")), "near").where("a <> b").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 2
        cuts.append(cut)
        asking = keep(gains(near, now, parts, cap, buckets).withColumn("turn", F.struct("gain", F.xxhash64("node", F.lit(at)).alias("h"), "node")))
        turns = asking.select(F.col("node").alias("near"), F.col("turn").alias("other")).repartition(buckets, "near")
        rivals = near.join(turns.hint("shuffle_hash"), "near").groupBy("node").agg(F.max("other").alias("other"))
        moving = asking.join(by_shuffle(rivals), "node", "left").where("other is null or turn > other").select("node", "want", "gain")
        held = now.groupBy("part").agg(F.count("*").alias("held")).withColumnRenamed("part", "want")
        allowed = ranked_down(keep(moving), ["want"], "gain").join(F.broadcast(held), "want", "left").where(F.col("_r") + F.coalesce("held", F.lit(0)) <= cap)
        after = keep(now.join(by_shuffle(allowed.select("node", "want")), "node", "left").select("node", F.coalesce("want", "part").cast("int").alias("part"), F.col("want").isNotNull().alias("moved")))
        moved = after.where("moved").count()
        now = after.select("node", "part")
        if not moved:
            return now, cuts
    return now, cuts


def movement(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """One row: nodes whose majority owner is another than the given one, in-edges from other owners than the majority, and
    (node, minority owner) pairs: what moves if nodes are computed where most of their sources are."""
    counts = source_counts(edges, owners)
    totals = counts.groupBy("dst").agg(F.max(F.struct(F.col("n"), (-F.col("src_part")).alias("p"))).alias("m"), F.sum("n").alias("all"), F.count("*").alias("pairs"))
    rows = totals.join(owners, totals["dst"] == owners["node"])
    return rows.agg(
        F.sum(F.when(-F.col("m.p") != F.col("part"), 1).otherwise(0)).cast("bigint").alias("moved_nodes"),
        F.sum(F.col("all") - F.col("m.n")).cast("bigint").alias("minority_edges"),
        F.sum(F.col("pairs") - 1).cast("bigint").alias("minority_pairs"),
    )


def cut_matrix(edges: DataFrame, owners: DataFrame) -> DataFrame:
    return with_owners(edges, owners).groupBy("src_part", "dst_part").agg(F.count("*").alias("edges"))


def halo(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """One row: cut edges, distinct end points of cut edges, nodes and their ratio."""
    cut = with_owners(edges, owners).where("src_part <> dst_part")
    ends = cut.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    a, b, c = cut.agg(F.count("*").alias("cut_edges")), ends.agg(F.count("*").alias("halo_nodes")), owners.agg(F.count("*").alias("nodes"))
    return a.crossJoin(b).crossJoin(c).withColumn("halo_ratio", F.round(F.col("halo_nodes") / F.col("nodes"), 6))


def scatter(rows: DataFrame, owners: DataFrame, parts: int | None = None) -> DataFrame:
    """rows (node, ...) with part, all of an owner's rows in the same tasks; reading them back in any order is the gather."""
    out = rows.join(owners.select("node", "part"), "node")
    return out.repartition(parts, "part") if parts else out.repartition("part", F.pmod(F.xxhash64("node"), F.lit(64)))
