"""Graph tables that lie together: bucketed by the keys they are joined by, so a hop shuffles what it asks for and not the graph.

near is bucketed by (dst, pos), degrees, features, labels and owners by node, all into as many buckets. A hop sends its drawn
positions to near's buckets and a gather its node ids to the features' buckets; edges and vectors stay where they were written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from hopweave.operators.sampling import Adjacency, adjacency

from .graphs import Graph
from .kept import kept, shared_path


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    """df written as a table of one sorted file a bucket in the shared folder, and read back. The catalog's entry names that folder
    and holds no data of its own."""
    spark = df.sparkSession
    table = f"hopweave_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


@dataclass
class Colocated:
    near: DataFrame
    deg: DataFrame
    features: DataFrame
    labels: DataFrame
    owners: DataFrame
    buckets: int
    listed: Adjacency | None = None

    @property
    def adjacency(self) -> Adjacency:
        return self.listed or Adjacency(self.near, self.deg)


def colocate(g: Graph, buckets: int = 64, hub_rows: int = 100_000, lists: bool = False) -> Colocated:
    """buckets: about the tables' bytes over 256 MB; a hub's positions are dealt over all of them. With lists nodes' sources lie in
    their lists, bucketed by node, and near holds those of long nodes only: a hop then sends its frontier, not its draws."""
    graph = adjacency(kept(g.edges, "edges"), kept if lists else None, hub_rows)
    if lists:
        by_node = {n: bucketed(df, ["node"], buckets, n) for n, df in (("lists", graph.lists), ("features", g.features), ("labels", g.labels), ("owners", g.owners))}
        held = by_node.pop("lists")
        long = bucketed(graph.long, ["dst", "pos"], buckets, "near") if graph.hubs is not None else None
        return Colocated(graph.near, graph.deg, **by_node, buckets=buckets, listed=Adjacency(graph.near, graph.deg, held, long, graph.hubs))
    by_node = {n: bucketed(df, ["node"], buckets, n) for n, df in (("deg", graph.deg), ("features", g.features), ("labels", g.labels), ("owners", g.owners))}
    return Colocated(bucketed(graph.near, ["dst", "pos"], buckets, "near"), **by_node, buckets=buckets)
