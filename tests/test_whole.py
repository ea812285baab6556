"""What the queries cover: every node as a seed, whole vectors."""

from hopweave.plans import queries


def nodes(spark, sf):
    return {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}


def test_no_query_names_a_cut():
    assert not [k for k, v in queries.SQL.items() if "WHERE node < 64" in v or "range(1, 9)" in v]


def test_all_nodes_are_seeds(spark, sf):
    rows = queries.QUERIES["sample_two_hops"](spark, sf).where("layer = 0 and src = dst").collect()
    assert sorted(r["dst"] for r in rows) == sorted(nodes(spark, sf)) and len(rows) > 64
    assert len({r["batch"] for r in rows}) == -(-len(rows) // 16)


def test_lstm_reduces_every_node_of_both_layers(spark, sf):
    rows = queries.QUERIES["lstm_reduce"](spark, sf).select("batch", "layer", "node").distinct().collect()
    assert sorted(r["node"] for r in rows if r["layer"] == 0) == sorted(nodes(spark, sf))
    sampled = queries.QUERIES["sample_two_hops"](spark, sf).select("batch", "layer", "dst").distinct().collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in sampled}


def test_vectors_are_whole(spark, sf):
    for name in ("neighbour_sum", "remote_pull", "lstm_full_width"):
        dims = {r[0] for r in queries.QUERIES[name](spark, sf).select("dim").distinct().collect()}
        assert dims == set(range(64)), name


def test_three_layers_read_whole_vectors(spark, sf, monkeypatch):
    """A change of the last number of each vector changes the result."""
    from pyspark.sql import functions as F

    graph = queries.G.purchase_graph

    def changed(*args, **kwargs):
        g = graph(*args, **kwargs)
        last = F.col("vec")[F.size("vec") - 1]
        g.features = g.features.select("node", F.concat(F.slice("vec", 1, F.size("vec") - 1), F.array(last + 100)).alias("vec"))
        assert g.dims == 64
        return g

    run = queries.QUERIES["split_sage_three_layers"]
    before = {tuple(r) for r in run(spark, sf).collect()}
    monkeypatch.setattr(queries.G, "purchase_graph", changed)
    assert {tuple(r) for r in run(spark, sf).collect()} != before


def test_all_batches_of_clusters_are_returned(spark, sf):
    g = queries.load(spark, sf)
    part = {r["node"]: r["part"] for r in g.owners.collect()}
    want = {(part[r["src"]] % 2, r["src"], r["dst"]) for r in g.edges.collect() if part[r["src"]] % 2 == part[r["dst"]] % 2}
    rows = [tuple(r) for r in queries.QUERIES["whole_cluster_subgraph"](spark, sf).select("batch", "src", "dst").collect()]
    assert len(rows) == len(want) and set(rows) == want and {r[0] for r in rows} == {0, 1}
    assert {r[1:] for r in rows if r[0] == 0} == {tuple(r) for r in queries.QUERIES["cluster_subgraph"](spark, sf).collect()}
