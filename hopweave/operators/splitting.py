"""Splitting sampled blocks over owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .owners import with_owners


def split_blocks(blocks: DataFrame, owners: DataFrame, cache: DataFrame | None = None, last_layer: int | None = None) -> DataFrame:
    """blocks with src_part, dst_part, part (where the edge is computed) and natural.

    An edge belongs to its source's owner. With a cache (part, node), an edge of the last layer whose destination's owner caches
    the source belongs to that owner instead: such edges are natural, all others extra. Blocks of an owned adjacency carry the
    owners of their ends already.
    """
    if "src_part" in blocks.columns and "dst_part" in blocks.columns:
        rows = blocks.where("src_part is not null and dst_part is not null")
    else:
        rows = with_owners(blocks, owners)
    if cache is None:
        return rows.withColumn("part", F.col("src_part")).withColumn("natural", F.lit(False))
    held = cache.select(F.col("part").alias("dst_part"), F.col("node").alias("src"), F.lit(True).alias("_held")).distinct()
    rows = rows.join(held, ["dst_part", "src"], "left")
    natural = F.coalesce("_held", F.lit(False)) & (F.lit(last_layer is None) | (F.col("layer") == F.lit(last_layer if last_layer is not None else 0)))
    return rows.withColumn("natural", natural).withColumn("part", F.when(natural, F.col("dst_part")).otherwise(F.col("src_part"))).drop("_held")


def owned_nodes(split: DataFrame) -> DataFrame:
    """batch, layer, part, node: destinations by owner."""
    return split.select("batch", "layer", F.col("dst_part").alias("part"), F.col("dst").alias("node")).distinct()


def shuffle_nodes(split: DataFrame) -> DataFrame:
    """batch, layer, from_part, to_part, node: destinations of which one owner has partials for another."""
    return split.where("part <> dst_part").select("batch", "layer", F.col("part").alias("from_part"), F.col("dst_part").alias("to_part"), F.col("dst").alias("node")).distinct()


def conservation(blocks: DataFrame, split: DataFrame) -> DataFrame:
    """layer, edges, split_edges: equal if the split neither loses nor repeats an edge."""
    a = blocks.groupBy("layer").agg(F.count("*").alias("edges"))
    b = split.groupBy("layer").agg(F.count("*").alias("split_edges"))
    return a.join(b, "layer")


def local_ids(members: DataFrame, by: list[str]) -> DataFrame:
    """members (by..., node) with local_id: dense from 0 in node order within each group."""
    return members.withColumn("local_id", (F.row_number().over(Window.partitionBy(*by).orderBy("node")) - 1).cast("bigint"))


def encounter_ids(rows: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """by..., node, local_id in the order of each node's first position."""
    first = rows.groupBy(*by, "node").agg(F.min(position).alias("_p"))
    return first.withColumn("local_id", (F.row_number().over(Window.partitionBy(*by).orderBy("_p", "node")) - 1).cast("bigint")).drop("_p")


def grid(split: DataFrame) -> DataFrame:
    """batch, layer, src_part, dst_part, dst, row_id, edges: the compact rows of each (source owner, destination owner) cell."""
    cells = split.groupBy("batch", "layer", "src_part", "dst_part", "dst").agg(F.count("*").alias("edges"))
    order = Window.partitionBy("batch", "layer", "src_part", "dst_part").orderBy("dst")
    return cells.withColumn("row_id", (F.row_number().over(order) - 1).cast("bigint"))


def remote_rows(split: DataFrame) -> DataFrame:
    """batch, layer, part, node, local_id, remote: each source owner's destinations, its own first, then remote ones."""
    rows = split.select("batch", "layer", F.col("src_part").alias("part"), F.col("dst").alias("node"), (F.col("dst_part") != F.col("src_part")).alias("remote")).distinct()
    return rows.withColumn("local_id", (F.row_number().over(Window.partitionBy("batch", "layer", "part").orderBy("remote", "node")) - 1).cast("bigint"))


def label_parts(batches: DataFrame, labels: DataFrame, owners: DataFrame) -> DataFrame:
    """batch, part, node, label of the seeds by owner."""
    return batches.select("batch", "node").join(labels, "node").join(owners, "node").select("batch", "part", "node", "label")


def markers(split: DataFrame) -> DataFrame:
    """split with kind: self (an edge to itself), local (one owner) or remote."""
    kind = F.when(F.col("src") == F.col("dst"), "self").when(F.col("src_part") == F.col("dst_part"), "local").otherwise("remote")
    return split.withColumn("kind", kind)


def full_grid(split: DataFrame, parts: int = 4) -> DataFrame:
    """layer, src_part, dst_part, edges of every pair of owners, empty ones too."""
    layers = split.select("layer").distinct()
    ids = split.sparkSession.range(parts).select(F.col("id").cast("int").alias("src_part"))
    cells = layers.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(ids.withColumnRenamed("src_part", "dst_part")))  # parts^2 rows a layer
    n = split.groupBy("layer", "src_part", "dst_part").agg(F.count("*").alias("n"))
    return cells.join(n, ["layer", "src_part", "dst_part"], "left").select("layer", "src_part", "dst_part", F.coalesce("n", F.lit(0)).alias("edges"))


def relabel(split: DataFrame, keep=None) -> DataFrame:
    """batch, layer, part, src_id, dst_id: edges by the dense ids of their ends within (batch, layer, part).

    A batch's edges are sent to one task once; both ends are ranked there by node, as local_ids ranks them, and meet again by the
    number of their edge. keep is not needed any more.
    """
    by = ["batch", "layer", "part"]
    rows = split.select(*by, "src", "dst").repartition("batch").withColumn("_edge", F.monotonically_increasing_id())
    ends = rows.select(*by, "_edge", F.explode(F.array(F.struct(F.lit(True).alias("is_src"), F.col("src").alias("node")), F.struct(F.lit(False).alias("is_src"), F.col("dst").alias("node")))).alias("e"))
    ends = ends.withColumn("_id", (F.dense_rank().over(Window.partitionBy(*by).orderBy("e.node")) - 1).cast("bigint"))
    pairs = ends.groupBy(*by, "_edge").agg(F.max(F.when(F.col("e.is_src"), F.col("_id"))).alias("src_id"), F.max(F.when(~F.col("e.is_src"), F.col("_id"))).alias("dst_id"))
    return pairs.select(*by, "src_id", "dst_id")


def encountered(split: DataFrame, keep=None) -> DataFrame:
    """batch, layer, part, in_id, out_id: each part's edges by ids in the order in which its sources, and its destinations, are first
    met, edges being taken by destination, its self edge first.

    A batch's edges are sent to one task once and ranked there. Edges come by destination, so destinations are met in the order of
    their ids. keep is not needed any more.
    """
    by = ["batch", "layer", "part"]
    rows = split.select(*by, "src", "dst").repartition("batch")
    pos = F.struct("dst", (F.col("src") != F.col("dst")).alias("other"), "src")
    rows = rows.withColumn("_first", F.min(pos).over(Window.partitionBy(*by, "src")))
    rank = lambda c: (F.dense_rank().over(Window.partitionBy(*by).orderBy(c)) - 1).cast("bigint")
    return rows.select(*by, rank("_first").alias("in_id"), rank("dst").alias("out_id"))


def input_ids(split: DataFrame, cache: DataFrame, last_layer: int) -> DataFrame:
    """batch, part, node, local_id, cached of the input layer's sources: a cached node's id is its slot in the part's cache; the
    others are numbered after the part's slots, in the order of their ids."""
    held = cache.select("part", "node", "slot")
    room = held.groupBy("part").agg(F.count("*").alias("room"))  # a row an owner
    rows = split.where(F.col("layer") == last_layer).select("batch", "part", F.col("src").alias("node")).distinct()
    rows = rows.join(held, ["part", "node"], "left").join(F.broadcast(room), "part", "left").withColumn("cached", F.col("slot").isNotNull())
    order = F.row_number().over(Window.partitionBy("batch", "part", "cached").orderBy("node")) - 1
    return rows.select("batch", "part", "node", F.when(F.col("cached"), F.col("slot")).otherwise(F.coalesce("room", F.lit(0)) + order).cast("bigint").alias("local_id"), "cached")


def sample_counts(split: DataFrame) -> DataFrame:
    """batch, layer, part, edges, self_edges, in_nodes, out_nodes, owned, received: what one sample object of a part holds, counted.
    owned: destinations that are the part's own; received: partials that other owners compute for them."""
    by = ["batch", "layer", "part"]
    rows = split.select(*by, "dst_part", "src", "dst").repartition("batch")  # a batch's edges meet once; all that follows is local
    first = lambda *c: (F.row_number().over(Window.partitionBy(*by, *c).orderBy(*c)) == 1).cast("bigint")
    own, zero = F.col("part") == F.col("dst_part"), F.lit(0).cast("bigint")
    rows = rows.select("*", first("src").alias("_in"), first("dst").alias("_out"), first("dst", "dst_part").alias("_to"))
    held = F.struct("part", F.lit(1).cast("bigint").alias("edges"), (F.col("src") == F.col("dst")).cast("bigint").alias("self_edges"), F.col("_in").alias("in_nodes"), F.col("_out").alias("out_nodes"), F.when(own, F.col("_to")).otherwise(zero).alias("owned"), zero.alias("received"))
    sent = F.struct(F.col("dst_part").alias("part"), *[zero.alias(c) for c in ("edges", "self_edges", "in_nodes", "out_nodes", "owned")], F.col("_to").alias("received"))
    cells = rows.select("batch", "layer", F.explode(F.when(own | (F.col("_to") == 0), F.array(held)).otherwise(F.array(held, sent))).alias("c")).select("batch", "layer", "c.*")
    return cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("edges", "self_edges", "in_nodes", "out_nodes", "owned", "received")])


def model_input(split: DataFrame) -> DataFrame:
    """batch, layer, part, kind, peer, src, dst: all that one owner's model takes of a layer, in one table. edge: what it computes;
    owned: the destinations it holds; to and from: destinations whose partials it sends to or gets from the owner `peer`."""
    key = ["batch", "layer"]
    none = F.lit(None).cast("bigint")
    edges = split.select(*key, "part", F.lit("edge").alias("kind"), F.lit(-1).alias("peer"), "src", "dst")
    owned = owned_nodes(split).select(*key, "part", F.lit("owned").alias("kind"), F.lit(-1).alias("peer"), none.alias("src"), F.col("node").alias("dst"))
    moved = shuffle_nodes(split)
    to = moved.select(*key, F.col("from_part").alias("part"), F.lit("to").alias("kind"), F.col("to_part").alias("peer"), none.alias("src"), F.col("node").alias("dst"))
    from_ = moved.select(*key, F.col("to_part").alias("part"), F.lit("from").alias("kind"), F.col("from_part").alias("peer"), none.alias("src"), F.col("node").alias("dst"))
    return edges.unionByName(owned).unionByName(to).unionByName(from_)
