"""The registered queries: each a plan over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions import vectors as V
from hopweave.functions.portable import weights
from hopweave.operators import aggregation as A
from hopweave.operators import caching as C
from hopweave.operators import ingest as I
from hopweave.operators import layers as L
from hopweave.operators import metrics as M
from hopweave.operators import owners as O
from hopweave.operators import sampling as S
from hopweave.operators import splitting as B
from hopweave.operators.training import train
from hopweave.sources import binary as R
from hopweave.sources import graphs as G
from hopweave.sources import partitioner as W
from hopweave.sources.colocated import bucketed, colocate
from hopweave.sources.kept import kept, shared_path
from hopweave.sources.publishing import publish, published

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIMS = G.DIMS
CLASSES = 10

# --- SQL of what queries share



def floyd_sql(k: int, key: str, deg: str = "d.deg") -> str:
    """At most k positions below deg, drawn without replacement with the given key; as drawn_positions."""
    draw = f"('0x' || substr(md5(concat_ws(':', '1', {key}, j::VARCHAR)), 1, 8))::BIGINT % (j + 1)"
    pairs = f"list_transform(range({deg} - {k}, {deg}), lambda j: [j, {draw}])"
    return f"CASE WHEN {deg} <= {k} THEN range({deg}) ELSE list_reduce(list_prepend([]::BIGINT[], {pairs}), lambda a, x: list_append(a, CASE WHEN list_contains(a, x[2]) THEN x[1] ELSE x[2] END)) END"


def hop_sql(frontier: str, layer: int, k: int) -> str:
    """batch, layer, dst, src: k sampled in-neighbours of each of the frontier's nodes, and its self edge."""
    drawn = f"SELECT f.batch, f.node, unnest({floyd_sql(k, f"f.batch::VARCHAR, '{layer}', f.node::VARCHAR")}) AS i FROM {frontier} f JOIN d ON d.node = f.node"
    return f"SELECT p.batch, {layer} AS layer, g.dst, g.src FROM ({drawn}) p JOIN near g ON g.dst = p.node AND g.i = p.i UNION ALL SELECT batch, {layer}, node, node FROM {frontier}"


CTE = {
    "n": "n AS (SELECT p_partkey::BIGINT AS node FROM part)",
    "e": "e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) = 1 AND a.l_partkey <> b.l_partkey)",
    "o": "o AS (SELECT node, (node % 4)::INT AS part FROM n)",
    "x": f"x AS MATERIALIZED (SELECT n.node, i - 1 AS dim, m.embedding[i]::DOUBLE AS value FROM n JOIN embeddings m ON m.vec_id = n.node % (SELECT count(*) FROM embeddings), range(1, {DIMS + 1}) t(i))",
    "vs": "vs AS (SELECT node, round(sum(value), 6) AS total, round(sum(value * (dim + 1)), 4) AS weighted FROM x GROUP BY node)",
    "y": "y AS (SELECT n.node, m.label FROM n JOIN embeddings m ON m.vec_id = n.node % (SELECT count(*) FROM embeddings))",
    "d": "d AS (SELECT dst AS node, count(*) AS deg FROM e GROUP BY dst)",
    # every node a seed, in batches of 16, sampled over two hops with fan-out 10 and 5
    "b": "b AS (SELECT node, (row_number() OVER (ORDER BY md5(concat_ws(':', '1', '0', node::VARCHAR)), node) - 1)::BIGINT AS rank FROM n)",
    "f0": "f0 AS (SELECT rank // 16 AS batch, node FROM b)",
    "near": "near AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS i FROM e)",
    "l0": f"l0 AS MATERIALIZED ({hop_sql('f0', 0, 10)})",
    "f1": "f1 AS (SELECT DISTINCT batch, src AS node FROM l0)",
    "l1": f"l1 AS MATERIALIZED ({hop_sql('f1', 1, 5)})",
    "f2": "f2 AS (SELECT DISTINCT batch, src AS node FROM l1)",
    "l2": f"l2 AS ({hop_sql('f2', 2, 3)})",
    "bl": "bl AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1)",
    "s": "s AS MATERIALIZED (SELECT bl.*, p.part AS src_part, q.part AS dst_part, p.part AS part FROM bl JOIN o p ON p.node = bl.src JOIN o q ON q.node = bl.dst)",
    "inp": "inp AS (SELECT DISTINCT batch, src AS node FROM l1)",
    # all edges and a self edge each
    "a": "a AS (SELECT src, dst FROM e UNION ALL SELECT node, node FROM n)",
    "sa": "sa AS (SELECT a.src, a.dst, p.part FROM a JOIN o p ON p.node = a.src)",
}
NEEDS = {"vs": "x", "d": "e", "o": "n", "x": "n", "y": "n", "b": "n", "f0": "b", "near": "e", "l0": "f0 d near", "f1": "l0", "l1": "f1 d near", "f2": "l1", "l2": "f2 d near", "bl": "l0 l1", "s": "bl o", "inp": "l1", "a": "e n", "sa": "a o"}


def sql(needs: str, text: str, recursive: str = "") -> str:
    """text after the common tables it needs."""
    out: list[str] = []

    def add(k: str) -> None:
        for x in NEEDS.get(k, "").split():
            add(x)
        if CTE[k] not in out:
            out.append(CTE[k])

    for k in needs.split():
        add(k)
    body = text.strip()
    return f"WITH {recursive}{', '.join(out)}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"


def w_table(name: str, rows: int, columns: int) -> str:
    return f"{name} AS (SELECT i, k, ((i * 7 + k * 3) % 11 - 5) / 10.0 AS w FROM range({rows}) t(i), range({columns}) u(k))"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def seeds(g: G.Graph) -> DataFrame:
    """All nodes in batches of 16."""
    return S.make_batches(g.nodes, 16)


def sampled(g: G.Graph, last: bool = True) -> DataFrame:
    """Two hops; edges and each hop are written once and read by all that follows (the last hop not, with last=False)."""
    g.edges = kept(g.edges, "edges")
    return S.sample_blocks(S.adjacency(g.edges, kept), seeds(g), [10, 5], keep=kept, last=last)


def sampled_coded(g: G.Graph) -> tuple[DataFrame, DataFrame | G.Coded]:
    """The sample of two hops, its last hop not written, and the vectors. With a book the codes lie in the nodes' lists, where draws
    find them, and the sample is a row a destination; edges are neither joined to codes nor grouped."""
    h = g.vectors()
    if not isinstance(h, G.Coded):
        return sampled(g, last=False), h
    g.edges = kept(g.edges, "edges")
    lists = S.adjacency(g.edges, kept, owners=A.known_codes(h).withColumnRenamed("code", "part"))
    return S.sample_lists(lists, seeds(g), [10, 5], keep=kept, last=False), h


def split(g: G.Graph) -> DataFrame:
    """The split of a sample whose edges carry the owners of their ends; its last hop is not written."""
    g.edges = kept(g.edges, "edges")
    return B.split_blocks(S.sample_blocks(S.adjacency(g.edges, kept, owners=g.owners), seeds(g), [10, 5], keep=kept, last=False), g.owners)


def whole_block(g: G.Graph) -> DataFrame:
    """All edges and a self edge each, as one block."""
    return g.edges.unionByName(g.nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))


def whole_split(g: G.Graph) -> DataFrame:
    s = g.owners.select(F.col("node").alias("src"), "part")
    return whole_block(g).join(s, "src")


def load(spark: SparkSession, sf_dir: str) -> G.Graph:
    return G.purchase_graph(spark, sf_dir)


# --- ingest


@query(sql("e", "SELECT src, dst FROM e"))
def edges(spark, sf_dir):
    return G.purchase_edges(spark, sf_dir)


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem")
def bipartite_edges(spark, sf_dir):
    return G.bipartite_edges(spark, sf_dir)


@query("""WITH w AS (SELECT (id // 250) * 50 AS base, id FROM range(1000) t(id)),
e AS (SELECT base + ('0x' || substr(md5('1:src:' || id), 1, 8))::BIGINT % 50 AS src, base + ('0x' || substr(md5('1:dst:' || id), 1, 8))::BIGINT % 50 AS dst FROM w),
c AS (SELECT ('0x' || substr(md5('1:xsrc:' || id), 1, 8))::BIGINT % 200 AS src, ('0x' || substr(md5('1:xdst:' || id), 1, 8))::BIGINT % 200 AS dst FROM range(400) t(id))
SELECT DISTINCT src, dst FROM (SELECT * FROM e UNION ALL SELECT * FROM c WHERE src // 50 <> dst // 50) WHERE src <> dst""")
def synthetic_edges(spark, sf_dir):
    return G.synthetic_edges(spark)


@query(sql("e", "SELECT count(*)::BIGINT AS edges, sum(src)::BIGINT AS src_sum FROM (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e WHERE src < dst UNION ALL SELECT dst, src FROM e WHERE src < dst) WHERE src <> dst)"))
def symmetrized(spark, sf_dir):
    half = I.drop_self_loops(I.simplify(G.purchase_edges(spark, sf_dir))).where("src < dst")
    return I.symmetrize(half).agg(F.count("*").alias("edges"), F.sum("src").alias("src_sum"))


@query(sql("d", "SELECT node, deg FROM d"))
def in_degree(spark, sf_dir):
    return I.in_degrees(G.purchase_edges(spark, sf_dir))


@query(sql("n d", "SELECT n.node, coalesce(deg, 0)::BIGINT AS deg, (sum(coalesce(deg, 0)) OVER (ORDER BY n.node ROWS UNBOUNDED PRECEDING) - coalesce(deg, 0))::BIGINT AS begin FROM n LEFT JOIN d ON d.node = n.node"))
def csr_offsets(spark, sf_dir):
    g = load(spark, sf_dir)
    return I.csr_offsets(g.edges, g.nodes)


@query(sql("n d e y", """WITH f AS (SELECT sum(coalesce(deg, 0)) OVER (ORDER BY n.node ROWS UNBOUNDED PRECEDING) - coalesce(deg, 0) AS begin FROM n LEFT JOIN d ON d.node = n.node)
SELECT (SELECT count(*) FROM e) AS num_edges, (SELECT sum(src)::BIGINT FROM e) AS csum_edges, (SELECT count(*) FROM f) AS num_nodes, (SELECT sum(begin)::BIGINT FROM f) AS csum_offsets, (SELECT max(label) + 1 FROM y)::BIGINT AS num_classes, (SELECT sum(label)::BIGINT FROM y) AS csum_labels"""))
def checksums(spark, sf_dir):
    g = load(spark, sf_dir)
    return I.checksums(g.edges, g.nodes, g.labels)


@query(sql("n e y", "SELECT 'num_edges' AS key, count(*)::BIGINT AS value FROM e UNION ALL SELECT 'csum_edges', sum(src)::BIGINT FROM e UNION ALL SELECT 'num_nodes', count(*) FROM n UNION ALL SELECT 'num_classes', (max(label) + 1)::BIGINT FROM y UNION ALL SELECT 'csum_labels', sum(label)::BIGINT FROM y"))
def graph_meta(spark, sf_dir):
    return G.meta(load(spark, sf_dir))


@query(sql("y", "SELECT node, (CASE WHEN label % 3 = 0 THEN 0 ELSE label END)::INT AS label FROM y"))
def clean_labels(spark, sf_dir):
    g = load(spark, sf_dir)
    return I.clean_labels(g.labels.select("node", F.when(F.col("label") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("label").cast("double")).alias("label")))


@query(sql("n", """SELECT node, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split, CASE WHEN r <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'val' END AS permuted
FROM (SELECT node, ('0x' || substr(md5('1:split:' || node), 1, 8))::BIGINT / 4294967296.0 AS u, row_number() OVER (ORDER BY md5('1:permute:' || node), node) AS r FROM n)"""))
def splits(spark, sf_dir):
    nodes = load(spark, sf_dir).nodes
    return I.random_split(nodes).join(I.permutation_split(nodes).withColumnRenamed("split", "permuted"), "node")


@query(sql("n d e", "SELECT n.node, trim(concat_ws(' ', coalesce(floor(10 * d.deg / (SELECT max(deg) FROM d)), 0)::BIGINT::VARCHAR, coalesce(m.near, ''))) AS line FROM n LEFT JOIN d ON d.node = n.node LEFT JOIN (SELECT dst, string_agg((src + 1)::VARCHAR, ' ' ORDER BY src) AS near FROM e GROUP BY dst) m ON m.dst = n.node"))
def metis_rows(spark, sf_dir):
    g = load(spark, sf_dir)
    return G.metis_rows(kept(g.edges, "edges"), g.nodes)


@query(sql("n d e", """WITH l AS (SELECT n.node, trim(concat_ws(' ', coalesce(floor(10 * d.deg / (SELECT max(deg) FROM d)), 0)::BIGINT::VARCHAR, coalesce(m.near, ''))) || chr(10) AS line FROM n LEFT JOIN d ON d.node = n.node LEFT JOIN (SELECT dst, string_agg((src + 1)::VARCHAR, ' ' ORDER BY src) AS near FROM e GROUP BY dst) m ON m.dst = n.node
UNION ALL SELECT -1, (SELECT count(*) FROM n) || ' ' || (SELECT count(*) FROM e WHERE src < dst) || ' 100' || chr(10))
SELECT node, (sum(length(line)) OVER (ORDER BY node ROWS UNBOUNDED PRECEDING) - length(line))::BIGINT AS "begin", length(line)::BIGINT AS bytes FROM l"""))
def partitioner_lines(spark, sf_dir):
    """Where each node's line lies in the partitioner's input, from pieces of 4 neighbours."""
    g = load(spark, sf_dir)
    pieces = W.line_chunks(kept(g.edges, "edges"), g.nodes, 4, keep=kept)
    return pieces.groupBy("node").agg(F.min("offset").alias("begin"), F.sum("bytes").alias("bytes"))


@query(sql("d", "SELECT node, deg, floor(10 * deg / (SELECT max(deg) FROM d))::BIGINT AS size FROM d"))
def vertex_sizes(spark, sf_dir):
    return I.vertex_sizes(G.purchase_edges(spark, sf_dir))


@query("SELECT avg(x::DOUBLE) AS mean, count(*) AS n, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END AS status FROM (SELECT unnest(regexp_extract_all(props, '\"k\": ([0-9]+)', 1)) AS x FROM events)")
def log_scrape(spark, sf_dir):
    return G.scrape_logs(G.table(spark, sf_dir, "events").select(F.col("props").alias("value")), '"k": ([0-9]+)')


@query(sql("n d e y o vs", """WITH m AS (SELECT dst AS node, sum(src)::BIGINT AS src_sum FROM e GROUP BY dst)
SELECT n.node, coalesce(d.deg, 0)::BIGINT AS deg, coalesce(m.src_sum, 0)::BIGINT AS src_sum, y.label, o.part, vs.total, vs.weighted FROM n JOIN y ON y.node = n.node JOIN o ON o.node = n.node JOIN vs ON vs.node = n.node LEFT JOIN d ON d.node = n.node LEFT JOIN m ON m.node = n.node"""))
def binary_folder(spark, sf_dir):
    """The graph (its nodes are 0 .. N-1) written as a folder of raw arrays and read back by byte ranges, its sums verified."""
    g = load(spark, sf_dir)
    g.edges = kept(g.edges, "edges")
    path = shared_path(spark, "graph")
    R.write_folder(g, path)
    g = R.read_folder(spark, path)
    near = g.edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("deg"), F.sum("src").alias("src_sum"))
    rows = V.sums(g.features, ["node"]).join(near, "node", "left").join(g.labels.select("node", "label"), "node").join(g.owners, "node")
    return rows.select("node", F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("src_sum", F.lit(0)).alias("src_sum"), "label", "part", "total", "weighted")


# --- owners


@query(sql("n o e", """WITH c AS (SELECT e.dst, o.part, count(*) AS k FROM e JOIN o ON o.node = e.src GROUP BY 1, 2),
m AS (SELECT dst, part FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY k DESC, part) AS r FROM c) WHERE r = 1)
SELECT n.node, o.part AS modulo, least(n.node * 4 // (SELECT max(node) + 1 FROM n), 3)::INT AS contiguous, coalesce(m.part, o.part)::INT AS majority FROM n JOIN o ON o.node = n.node LEFT JOIN m ON m.dst = n.node"""))
def owner_policies(spark, sf_dir):
    g = load(spark, sf_dir)
    policies = {"modulo": O.modulo(g.nodes), "contiguous": O.contiguous(g.nodes), "majority": O.majority(g.edges, g.owners)}
    out = g.nodes
    for name, p in policies.items():
        out = out.join(p.withColumnRenamed("part", name), "node")
    return out


@query(sql("n o e", """WITH c AS (SELECT e.dst, o.part, count(*) AS k FROM e JOIN o ON o.node = e.src GROUP BY 1, 2),
m AS (SELECT dst, part, k FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY k DESC, part) AS r FROM c) WHERE r = 1),
v AS (SELECT o.node, o.part, coalesce(m.part, o.part) AS want, m.k FROM o LEFT JOIN m ON m.dst = o.node),
h AS (SELECT want, count(*) AS held FROM v WHERE want = part GROUP BY want),
q AS (SELECT v.node, v.want, row_number() OVER (PARTITION BY v.want ORDER BY v.k DESC, v.node) + coalesce(h.held, 0) AS r FROM v LEFT JOIN h ON h.want = v.want WHERE v.want <> v.part)
SELECT o.node, coalesce(q.want, o.part)::INT AS part FROM o LEFT JOIN q ON q.node = o.node AND q.r <= (SELECT count(*) FROM o) * (1.1 / 4)"""))
def propagated_owners(spark, sf_dir):
    g = load(spark, sf_dir)
    return O.label_propagation(g.edges, g.owners)


@query()
def balanced_owners(spark, sf_dir):
    """Owners after ten rounds of balanced label propagation, from one pass's owners; the operator's own end is its fixed point."""
    g = load(spark, sf_dir)
    edges = kept(g.edges, "edges")
    return O.balanced_partition(edges, O.label_propagation(edges, g.owners), most_rounds=10, keep=kept, measure=False, lay=partial(bucketed, name="near"))[0]


@query(sql("o e", """WITH c AS (SELECT e.dst, o.part, count(*) AS k FROM e JOIN o ON o.node = e.src GROUP BY 1, 2),
m AS (SELECT dst, sum(k) AS a, max(k) AS k, count(*) AS p, min_by(part, (-k, part)) AS part FROM c GROUP BY dst)
SELECT sum((m.part <> o.part)::INT)::BIGINT AS moved_nodes, sum(a - k)::BIGINT AS minority_edges, sum(p - 1)::BIGINT AS minority_pairs FROM m JOIN o ON o.node = m.dst"""))
def majority_movement(spark, sf_dir):
    g = load(spark, sf_dir)
    return O.movement(g.edges, g.owners)


@query(sql("o e", "SELECT p.part AS src_part, q.part AS dst_part, count(*) AS edges FROM e JOIN o p ON p.node = e.src JOIN o q ON q.node = e.dst GROUP BY 1, 2"))
def cut_matrix(spark, sf_dir):
    g = load(spark, sf_dir)
    return O.cut_matrix(g.edges, g.owners)


@query(sql("o e", "SELECT 'cut' AS run, p.part AS src_part, q.part AS dst_part, count(*) AS edges FROM e JOIN o p ON p.node = e.src JOIN o q ON q.node = e.dst GROUP BY 2, 3"))
def published_cuts(spark, sf_dir):
    """The cut matrix as a run's results, published twice, as a retry would, and read back."""
    g = load(spark, sf_dir)
    path, rows = shared_path(spark, "results"), kept(O.cut_matrix(g.edges, g.owners), "cuts")
    for _ in range(2):
        publish(rows, path, "cut")
    return published(spark, path, "src_part int, dst_part int, edges long")


@query(sql("o e", """WITH c AS (SELECT e.src, e.dst FROM e JOIN o p ON p.node = e.src JOIN o q ON q.node = e.dst WHERE p.part <> q.part),
h AS (SELECT count(DISTINCT node) AS k FROM (SELECT src AS node FROM c UNION ALL SELECT dst FROM c))
SELECT (SELECT count(*) FROM c) AS cut_edges, k AS halo_nodes, (SELECT count(*) FROM o) AS nodes, round(k / (SELECT count(*) FROM o), 6) AS halo_ratio FROM h"""))
def halo(spark, sf_dir):
    g = load(spark, sf_dir)
    return O.halo(g.edges, g.owners)


# --- batches and samples


@query(sql("n", "SELECT rank // 100 AS batch, node, rank, rank // ceil(count(*) OVER () / 4)::BIGINT AS worker FROM (SELECT node, (row_number() OVER (ORDER BY md5(concat_ws(':', '1', '0', node::VARCHAR)), node) - 1)::BIGINT AS rank FROM n)"))
def batches(spark, sf_dir):
    return S.worker_shares(S.make_batches(load(spark, sf_dir).nodes, 100))


@query(sql("n", "SELECT (ceil(count(*) / 100) * 3)::BIGINT AS samples FROM n"))
def expected_batches(spark, sf_dir):
    return S.expected_batches(load(spark, sf_dir).nodes, 100, 3)


@query(sql("bl", "SELECT batch, layer, dst, src FROM bl"))
def sample_two_hops(spark, sf_dir):
    return sampled(load(spark, sf_dir))


def replaced_sql(frontier: str, layer: int, self_edges: bool, distinct: bool = False) -> str:
    """batch, layer, dst, src: all in-neighbours of a node of fewer than 10, else 10 draws with replacement."""
    draw = f"('0x' || substr(md5(concat_ws(':', '1', f.batch::VARCHAR, '{layer}', f.node::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % d.deg"
    drawn = f"SELECT f.batch, f.node, CASE WHEN d.deg < 10 THEN k ELSE {draw} END AS i FROM {frontier} f JOIN d ON d.node = f.node, range(10) t(k) WHERE d.deg >= 10 OR k < d.deg"
    own = f" UNION ALL SELECT batch, {layer}, node, node FROM {frontier}" if self_edges else ""
    return f"SELECT {'DISTINCT' if distinct else ''} p.batch, {layer} AS layer, g.dst, g.src FROM ({drawn}) p JOIN near g ON g.dst = p.node AND g.i = p.i{own}"


def replaced_hops(hops: int, self_edges: bool, distinct: bool = False) -> str:
    """r0, r1, ...: the blocks of so many hops from f0."""
    out = [f"r0 AS MATERIALIZED ({replaced_sql('f0', 0, self_edges, distinct)})"]
    for i in range(1, hops):
        out.append(f"h{i} AS (SELECT DISTINCT batch, src AS node FROM r{i - 1}), r{i} AS MATERIALIZED ({replaced_sql(f'h{i}', i, self_edges, distinct)})")
    return ", ".join(out)


#: One row a batch and layer of blocks of (batch, layer, dst, src): edges, and two sums that tell their ends apart.
DIGEST = "batch, layer, count(*) AS edges, sum(src * (1 + dst % 7))::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum"


def digest(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("batch", "layer").agg(F.count("*").alias("edges"), F.sum(F.col("src") * (1 + F.col("dst") % 7)).alias("src_sum"), F.sum("dst").alias("dst_sum"))


@query(sql("f0 d near", f"WITH {replaced_hops(2, True)} SELECT * FROM r0 UNION ALL SELECT * FROM r1"))
def sample_with_replacement(spark, sf_dir):
    """Every drawn edge, repeats too."""
    g = load(spark, sf_dir)
    return S.sample_blocks(g.edges, seeds(g), [10, 10], strategy="replaced", keep=kept)


@query(sql("f0 d near", f"WITH {replaced_hops(2, False)} SELECT {DIGEST} FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1) GROUP BY 1, 2"))
def sample_without_self_edges(spark, sf_dir):
    """Two hops with replacement of whole 64-bit ids, no self edges and no removal of repeats."""
    g = load(spark, sf_dir)
    return digest(S.sample_blocks(g.edges, seeds(g), [10, 10], strategy="replaced", keep=kept, self_edges=False))


@query(sql("f0 d near", f"WITH {replaced_hops(2, False, True)} SELECT * FROM r0 UNION ALL SELECT * FROM r1"))
def sample_distinct(spark, sf_dir):
    g = load(spark, sf_dir)
    return S.sample_blocks(g.edges, seeds(g), [10, 10], strategy="distinct", keep=kept)


@query(sql("f0 d near", f"WITH {replaced_hops(3, False, True)} SELECT {DIGEST} FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2"))
def distinct_three_hops(spark, sf_dir):
    g = load(spark, sf_dir)
    return digest(S.sample_blocks(g.edges, seeds(g), [10, 10, 10], strategy="distinct", keep=kept, last=False))


NATIVE = f"{replaced_hops(3, True)}, nb AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)"


@query(sql("f0 d near o", f"WITH {NATIVE} SELECT nb.layer, p.part, q.part AS dst_part, count(*) AS edges, sum(nb.src * (1 + nb.dst % 7))::BIGINT AS src_sum FROM nb JOIN o p ON p.node = nb.src JOIN o q ON q.node = nb.dst GROUP BY 1, 2, 3"))
def native_three_hops(spark, sf_dir):
    """Three hops of 10 draws with replacement and a self edge, each edge with its source's owner."""
    g = load(spark, sf_dir)
    graph = S.adjacency(kept(g.edges, "edges"), kept, owners=g.owners)
    rows = B.split_blocks(S.sample_blocks(graph, seeds(g), [10, 10, 10], strategy="replaced", keep=kept, last=False), g.owners)
    return rows.groupBy("layer", "part", "dst_part").agg(F.count("*").alias("edges"), F.sum(F.col("src") * (1 + F.col("dst") % 7)).alias("src_sum"))


@query(sql("f0 d near", f"WITH {NATIVE} SELECT 0 AS part, {DIGEST} FROM nb GROUP BY batch, layer"))
def native_unsplit(spark, sf_dir):
    """The same three hops with all edges at owner 0."""
    g = load(spark, sf_dir)
    return digest(S.sample_blocks(g.edges, seeds(g), [10, 10, 10], strategy="replaced", keep=kept, last=False)).select(F.lit(0).alias("part"), "*")


@query(sql("f0 e", """WITH q0 AS (SELECT f0.batch, e.dst, e.src FROM f0 JOIN e ON e.dst = f0.node), q1 AS (SELECT f.batch, e.dst, e.src FROM (SELECT DISTINCT batch, src AS node FROM q0) f JOIN e ON e.dst = f.node)
SELECT batch, 0 AS layer, dst, count(*) AS edges, sum(src)::BIGINT AS src_sum FROM q0 GROUP BY 1, 2, 3 UNION ALL SELECT batch, 1, dst, count(*), sum(src)::BIGINT FROM q1 GROUP BY 1, 2, 3"""))
def sample_all_neighbours(spark, sf_dir):
    g = load(spark, sf_dir)
    return S.sample_blocks(kept(g.edges, "edges"), seeds(g), [-1, -1], strategy="full", keep=kept).groupBy("batch", "layer", "dst").agg(F.count("*").alias("edges"), F.sum("src").alias("src_sum"))


def cooperative_sql(frontier: str, layer: int, k: int) -> str:
    """As hop_sql over a frontier of (batch, node, part), every draw keyed by the part too."""
    drawn = f"SELECT f.batch, f.node, f.part, unnest({floyd_sql(k, f"f.part::VARCHAR, f.batch::VARCHAR, '{layer}', f.node::VARCHAR")}) AS i FROM {frontier} f JOIN d ON d.node = f.node"
    block = f"SELECT p.batch, g.dst, g.src, p.part AS dst_part FROM ({drawn}) p JOIN near g ON g.dst = p.node AND g.i = p.i UNION ALL SELECT batch, node, node, part FROM {frontier}"
    return f"SELECT b.batch, {layer} AS layer, b.dst_part, o.part AS src_part, b.dst, b.src FROM ({block}) b JOIN o ON o.node = b.src"


COOPERATIVE = f"""q0 AS (SELECT f0.batch, f0.node, o.part FROM f0 JOIN o ON o.node = f0.node), c0 AS MATERIALIZED ({cooperative_sql("q0", 0, 10)}),
q1 AS (SELECT DISTINCT batch, src AS node, src_part AS part FROM c0)"""


@query(sql("f0 d near o", f"WITH {COOPERATIVE} SELECT * FROM c0"))
def sample_cooperative(spark, sf_dir):
    g = load(spark, sf_dir)
    return S.cooperative_block(S.adjacency(kept(g.edges, "edges"), kept), seeds(g).select("batch", "node"), g.owners, 0, 10)


@query(sql("e o", "SELECT p.part, count(*) AS edges, sum(e.src)::BIGINT AS src_sum FROM e JOIN o p ON p.node = e.src JOIN o q ON q.node = e.dst WHERE p.part = q.part GROUP BY 1"))
def owner_subgraphs(spark, sf_dir):
    g = load(spark, sf_dir)
    return S.within_owner(g.edges, g.owners).groupBy("part").agg(F.count("*").alias("edges"), F.sum("src").alias("src_sum"))


@query(sql("e o", "SELECT e.src, e.dst FROM e JOIN o p ON p.node = e.src JOIN o q ON q.node = e.dst WHERE p.part IN (0, 2) AND q.part IN (0, 2)"))
def cluster_subgraph(spark, sf_dir):
    g = load(spark, sf_dir)
    return S.owned_subgraph(g.edges, g.owners, [0, 2])


@query(sql("e o", "SELECT p.part % 2 AS batch, e.src, e.dst FROM e JOIN o p ON p.node = e.src JOIN o q ON q.node = e.dst WHERE p.part % 2 = q.part % 2"))
def whole_cluster_subgraph(spark, sf_dir):
    g = load(spark, sf_dir)
    return S.cluster_batches(g.edges, g.owners, [[0, 2], [1, 3]])


# --- splits


@query(sql("s", "SELECT layer, src_part, dst_part, count(*) AS edges FROM s GROUP BY 1, 2, 3"))
def split_counts(spark, sf_dir):
    return split(load(spark, sf_dir)).groupBy("layer", "src_part", "dst_part").agg(F.count("*").alias("edges"))


@query(sql("s", "SELECT DISTINCT batch, layer, dst_part AS part, dst AS node FROM s"))
def owned_nodes(spark, sf_dir):
    return B.owned_nodes(split(load(spark, sf_dir)))


@query(sql("s", "SELECT DISTINCT batch, layer, part AS from_part, dst_part AS to_part, dst AS node FROM s WHERE part <> dst_part"))
def shuffle_nodes(spark, sf_dir):
    return B.shuffle_nodes(split(load(spark, sf_dir)))


@query(sql("bl s", "SELECT layer, count(*) AS edges, (SELECT count(*) FROM s WHERE s.layer = bl.layer) AS split_edges FROM bl GROUP BY layer"))
def edge_conservation(spark, sf_dir):
    g = load(spark, sf_dir)
    blocks = sampled(g)
    return B.conservation(blocks, B.split_blocks(blocks, g.owners))


@query(sql("s", "SELECT batch, layer, part, node, (row_number() OVER (PARTITION BY batch, layer, part ORDER BY node) - 1)::BIGINT AS local_id FROM (SELECT DISTINCT batch, layer, part, src AS node FROM s)"))
def local_ids(spark, sf_dir):
    members = split(load(spark, sf_dir)).select("batch", "layer", "part", F.col("src").alias("node")).distinct()
    return B.local_ids(members, ["batch", "layer", "part"])


@query("SELECT l_suppkey AS supplier, node, (row_number() OVER (PARTITION BY l_suppkey ORDER BY p, node) - 1)::BIGINT AS local_id FROM (SELECT l_suppkey, l_partkey AS node, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY 1, 2)")
def encounter_ids(spark, sf_dir):
    rows = G.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("node"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return B.encounter_ids(rows, ["supplier"])


@query(sql("s", "SELECT batch, layer, src_part, dst_part, dst, count(*) AS edges, (row_number() OVER (PARTITION BY batch, layer, src_part, dst_part ORDER BY dst) - 1)::BIGINT AS row_id FROM s GROUP BY 1, 2, 3, 4, 5"))
def split_grid(spark, sf_dir):
    return B.grid(split(load(spark, sf_dir)))


@query(sql("s", "SELECT batch, layer, part, node, remote, (row_number() OVER (PARTITION BY batch, layer, part ORDER BY remote, node) - 1)::BIGINT AS local_id FROM (SELECT DISTINCT batch, layer, src_part AS part, dst AS node, dst_part <> src_part AS remote FROM s)"))
def remote_rows(spark, sf_dir):
    return B.remote_rows(split(load(spark, sf_dir)))


@query(sql("f0 y o", "SELECT f0.batch, o.part, f0.node, y.label FROM f0 JOIN y ON y.node = f0.node JOIN o ON o.node = f0.node"))
def label_parts(spark, sf_dir):
    g = load(spark, sf_dir)
    return B.label_parts(seeds(g), g.labels, g.owners)


# --- caches

TOP = "SELECT node, (row_number() OVER (ORDER BY deg DESC, node) - 1)::BIGINT AS slot FROM (SELECT n.node, coalesce(d.deg, 0) AS deg FROM n LEFT JOIN d ON d.node = n.node) QUALIFY slot < floor((SELECT count(*) FROM n) * {c})"
PARTED = "g AS (SELECT o.node, o.part, coalesce(d.deg, 0) AS deg FROM o LEFT JOIN d ON d.node = o.node), z AS (SELECT floor(count(*) * {c}) AS size FROM n)"


@query(sql("n d", TOP.format(c=0.1)))
def degree_cache(spark, sf_dir):
    g = load(spark, sf_dir)
    return C.top_by_degree(g.edges, g.nodes, 0.1)


@query(sql("inp n d", f"WITH t AS ({TOP.format(c=0.25)}) SELECT inp.batch, count(*) AS inputs, count(t.node) AS hits, round(count(t.node) / count(*), 6) AS rate FROM inp LEFT JOIN t ON t.node = inp.node GROUP BY 1"))
def cache_hit_rates(spark, sf_dir):
    g = load(spark, sf_dir)
    return C.hit_rates(M.input_nodes(sampled(g), 1), C.top_by_degree(g.edges, g.nodes, 0.25))


@query(sql("inp n d", f"WITH t AS ({TOP.format(c=0.25)}), r AS (SELECT count(*) AS i, count(t.node) AS h FROM inp LEFT JOIN t ON t.node = inp.node GROUP BY inp.batch) SELECT round(avg(h / i), 6) AS mean_rate, round(sum(h) / sum(i), 6) AS overall_rate FROM r"))
def mean_cache_hit_rate(spark, sf_dir):
    g = load(spark, sf_dir)
    return C.mean_hit_rate(C.hit_rates(M.input_nodes(sampled(g), 1), C.top_by_degree(g.edges, g.nodes, 0.25)))


@query(sql("inp n d vs", f"WITH t AS ({TOP.format(c=0.25)}) SELECT inp.batch, inp.node, t.node IS NOT NULL AS hit, vs.total, vs.weighted FROM inp LEFT JOIN t ON t.node = inp.node JOIN vs ON vs.node = inp.node"))
def cached_gather(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.sums(C.cached_gather(M.input_nodes(sampled(g, last=False), 1), C.top_by_degree(g.edges, g.nodes, 0.25), g.vectors()), ["batch", "node", "hit"])


@query(sql("n d o", f"WITH {PARTED.format(c=0.1)} SELECT part, node, slot FROM (SELECT part, node, (row_number() OVER (PARTITION BY part ORDER BY deg DESC, node) - 1)::BIGINT AS slot FROM g) WHERE slot < (SELECT size FROM z)"))
def partition_cache(spark, sf_dir):
    g = load(spark, sf_dir)
    return C.partition_cache(g.edges, g.nodes, g.owners, 0.1)


@query(sql("n d o", f"""WITH {PARTED.format(c=0.4)}, k AS (SELECT part, count(*) AS own FROM o GROUP BY part),
r AS (SELECT k.part, g.node, k.own, g.part = k.part AS mine, row_number() OVER (PARTITION BY k.part, g.part = k.part ORDER BY g.deg DESC, g.node) AS r FROM g, k)
SELECT part, node, (CASE WHEN mine THEN r ELSE own + r END - 1)::BIGINT AS slot FROM r WHERE mine OR r <= greatest((SELECT size FROM z) - own, 0)"""))
def large_partition_cache(spark, sf_dir):
    g = load(spark, sf_dir)
    return C.partition_cache(g.edges, g.nodes, g.owners, 0.4)


@query(sql("n d o inp", f"""WITH {PARTED.format(c=0.1)}, h AS (SELECT part, node FROM (SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY deg DESC, node) AS r FROM g) WHERE r <= (SELECT size FROM z))
SELECT inp.batch, o.part, inp.node, ((SELECT count(*) FROM h WHERE h.part = o.part) + row_number() OVER (PARTITION BY inp.batch, o.part ORDER BY inp.node) - 1)::BIGINT AS slot FROM inp JOIN o ON o.node = inp.node WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.part = o.part AND h.node = inp.node)"""))
def cache_refresh(spark, sf_dir):
    g = load(spark, sf_dir)
    return C.refresh(M.input_nodes(sampled(g, last=False), 1), g.owners, C.partition_cache(g.edges, g.nodes, g.owners, 0.1))


@query(sql("n d o s", f"""WITH {PARTED.format(c=0.1)}, h AS (SELECT part, node FROM (SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY deg DESC, node) AS r FROM g) WHERE r <= (SELECT size FROM z)),
c AS (SELECT s.layer, s.src_part, s.dst_part, s.layer = 1 AND h.node IS NOT NULL AS nat FROM s LEFT JOIN h ON h.part = s.dst_part AND h.node = s.src)
SELECT layer, CASE WHEN nat THEN dst_part ELSE src_part END AS part, dst_part, nat AS "natural", count(*) AS edges FROM c GROUP BY 1, 2, 3, 4"""))
def cache_aware_split(spark, sf_dir):
    g = load(spark, sf_dir)
    out = B.split_blocks(sampled(g), g.owners, C.partition_cache(g.edges, g.nodes, g.owners, 0.1), last_layer=1)
    return out.groupBy("layer", "part", "dst_part", "natural").agg(F.count("*").alias("edges"))


@query(sql("n d inp", f"WITH t AS ({TOP.format(c=0.05)}), u AS ({TOP.format(c=0.2)}) SELECT round(count(t.node) / count(*), 6) AS single_saving, round(count(u.node) / count(*), 6) AS pooled_saving FROM inp LEFT JOIN t ON t.node = inp.node LEFT JOIN u ON u.node = inp.node"))
def cache_saving(spark, sf_dir):
    g = load(spark, sf_dir)
    return C.cache_saving(M.input_nodes(sampled(g), 1), g.edges, g.nodes, 0.05)


# --- aggregation

OUT = "round({v}, 6) AS value"


@query(sql("e x", "SELECT e.dst AS node, x.dim::BIGINT AS dim, round(sum(x.value), 6) AS value FROM e JOIN x ON x.node = e.src GROUP BY 1, 2"))
def neighbour_sum(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.aggregate_neighbors(g.edges, g.vectors(), g.dims), ["node"])


@query(sql("a x", "SELECT a.dst AS node, x.dim::BIGINT AS dim, round(avg(x.value), 6) AS value FROM a JOIN x ON x.node = a.src GROUP BY 1, 2"))
def neighbour_mean(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.aggregate_neighbors(whole_block(g), g.vectors(), g.dims, reduce="mean"), ["node"])


@query(sql("e x", "SELECT e.dst AS node, x.dim::BIGINT AS dim, round(max(greatest(x.value, 0)), 6) AS value FROM e JOIN x ON x.node = e.src GROUP BY 1, 2"))
def neighbour_max(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.aggregate_neighbors(g.edges, L.activate(g.features), g.dims, reduce="max"), ["node"])


@query(sql("e x", "SELECT e.dst AS node, x.dim::BIGINT AS dim, round((sum(x.value) + any_value(o.value)) / (count(*) + 1), 6) AS value FROM e JOIN x ON x.node = e.src JOIN x o ON o.node = e.dst AND o.dim = x.dim GROUP BY 1, 2"))
def neighbour_gcn(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.gcn(g.edges, g.features, g.dims), ["node"])


@query(sql("e x", "SELECT e.dst AS node, x.dim::BIGINT AS dim, round(sum(x.value * ((e.src + e.dst) % 7 + 1) / 7.0), 6) AS value FROM e JOIN x ON x.node = e.src GROUP BY 1, 2"))
def weighted_sum(spark, sf_dir):
    g = load(spark, sf_dir)
    weighted = g.edges.withColumn("w", ((F.col("src") + F.col("dst")) % 7 + 1) / F.lit(7.0))
    return V.long_form(A.aggregate_neighbors(weighted, g.vectors(), g.dims, "u_mul_e", weight="w"), ["node"])


@query(sql("e x", "SELECT e.dst AS node, x.dim::BIGINT AS dim, round(sum(x.value * o.value), 6) AS value FROM e JOIN x ON x.node = e.src JOIN x o ON o.node = e.dst AND o.dim = x.dim GROUP BY 1, 2"))
def attention_gather(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.aggregate_neighbors(g.edges, g.vectors(), g.dims, "u_mul_v"), ["node"])


@query(sql("e x", "SELECT e.dst AS node, x.dim::BIGINT AS dim, round(sum(x.value + o.value), 6) AS value FROM e JOIN x ON x.node = e.src JOIN x o ON o.node = e.dst AND o.dim = x.dim GROUP BY 1, 2"))
def added_gather(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.aggregate_neighbors(g.edges, g.vectors(), g.dims, "u_add_v"), ["node"])


SOFT = w_table("wt", DIMS, 2) + """, lr AS (SELECT node, sum(CASE WHEN k = 0 THEN value * w END) AS l, sum(CASE WHEN k = 1 THEN value * w END) AS r FROM x JOIN wt ON wt.i = x.dim GROUP BY node),
q AS (SELECT e.src, e.dst, CASE WHEN p.l + q.r > 0 THEN p.l + q.r ELSE 0.2 * (p.l + q.r) END AS s FROM e JOIN lr p ON p.node = e.src JOIN lr q ON q.node = e.dst),
al AS (SELECT src, dst, exp(s - max(s) OVER (PARTITION BY dst)) AS v FROM q), alpha AS (SELECT src, dst, v / sum(v) OVER (PARTITION BY dst) AS alpha FROM al)"""


def heads(dims: int) -> tuple[list[float], list[float]]:
    w = weights(dims, 2)
    return [r[0] for r in w], [r[1] for r in w]


@query(sql("e x", f"WITH {SOFT} SELECT src, dst, round(alpha, 6) AS alpha FROM alpha"))
def edge_softmax(spark, sf_dir):
    g = load(spark, sf_dir)
    return A.edge_softmax(g.edges, g.vectors(), *heads(g.dims)).select("src", "dst", F.round("alpha", 6).alias("alpha"))


@query(sql("e x", f"WITH {SOFT} SELECT a.dst AS node, x.dim::BIGINT AS dim, round(sum(a.alpha * x.value), 6) AS value FROM alpha a JOIN x ON x.node = a.src GROUP BY 1, 2"))
def attention_sum(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.attention(g.edges, g.vectors(), g.dims, *heads(g.dims)), ["node"])


@query(sql("e x", "SELECT e.src AS node, x.dim::BIGINT AS dim, round(sum(x.value), 6) AS value FROM e JOIN x ON x.node = e.dst GROUP BY 1, 2"))
def sum_gradient(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.sum_gradient(g.edges, g.vectors(), g.dims), ["node"])


@query(sql("a x", "SELECT a.dst AS node, x.dim::BIGINT AS dim, round(sum(x.value), 6) AS value FROM a JOIN x ON x.node = a.src GROUP BY 1, 2"))
def split_sum(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.split_sum(whole_split(g), g.vectors(), g.dims), ["node"])


@query(sql("a x", "SELECT a.dst AS node, x.dim::BIGINT AS dim, round(avg(x.value), 6) AS value FROM a JOIN x ON x.node = a.src GROUP BY 1, 2"))
def split_mean(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.split_mean(whole_split(g), g.vectors(), g.dims), ["node"])


PAIRWISE = """p AS (SELECT sa.dst, sa.part, x.dim, avg(x.value) AS m FROM sa JOIN x ON x.node = sa.src GROUP BY 1, 2, 3),
r AS (SELECT p.*, p.part = o.part AS own, row_number() OVER (PARTITION BY p.dst, p.dim, p.part = o.part ORDER BY p.part) AS j, count(*) OVER (PARTITION BY p.dst, p.dim) - 1 AS k FROM p JOIN o ON o.node = p.dst),
pw AS (SELECT dst AS node, dim, sum(CASE WHEN own THEN m / 2.0 ** k ELSE m / 2.0 ** (k - j + 1) END) AS value FROM r GROUP BY 1, 2)"""


@query(sql("sa o x", f"WITH {PAIRWISE} SELECT node, dim::BIGINT AS dim, round(value, 6) AS value FROM pw"))
def pairwise_mean(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.pairwise_mean(whole_split(g), g.vectors(), g.owners, g.dims), ["node"])


HIDDEN = 4
_STATE = " + ".join(f"r.h[{j + 1}] * ((({j} * 7 + (k - 1) * 3) % 11 - 5) / 10.0)" for j in range(HIDDEN))
LSTM = f"""WITH {w_table('wt', DIMS, 4 * HIDDEN)}, gx AS (SELECT node, list(v ORDER BY k) AS g FROM (SELECT x.node, wt.k, sum(x.value * wt.w) AS v FROM x JOIN wt ON wt.i = x.dim GROUP BY 1, 2) GROUP BY node),
st AS MATERIALIZED (SELECT bl.batch, bl.layer, bl.dst, row_number() OVER (PARTITION BY bl.batch, bl.layer, bl.dst ORDER BY bl.src) AS t, count(*) OVER (PARTITION BY bl.batch, bl.layer, bl.dst) AS n, gx.g FROM bl JOIN gx ON gx.node = bl.src),
r AS (SELECT DISTINCT batch, layer, dst, n, 0::BIGINT AS t, list_transform(range({HIDDEN}), lambda j: 0.0::DOUBLE) AS h, list_transform(range({HIDDEN}), lambda j: 0.0::DOUBLE) AS c FROM st
UNION ALL SELECT batch, layer, dst, n, t, list_transform(range(1, {HIDDEN + 1}), lambda j: tanh(c[j]) / (1 + exp(-z[{2 * HIDDEN} + j]))), c FROM (
  SELECT batch, layer, dst, n, t, z, list_transform(range(1, {HIDDEN + 1}), lambda j: c[j] / (1 + exp(-z[{HIDDEN} + j])) + tanh(z[{3 * HIDDEN} + j]) / (1 + exp(-z[j]))) AS c FROM (
    SELECT r.batch, r.layer, r.dst, r.n, st.t, r.c, list_transform(range(1, {4 * HIDDEN + 1}), lambda k: st.g[k] + {_STATE}) AS z FROM r JOIN st ON st.batch = r.batch AND st.layer = r.layer AND st.dst = r.dst AND st.t = r.t + 1)))
SELECT batch, layer, dst AS node, (j - 1)::BIGINT AS dim, round(h[j], 6) AS value FROM r, range(1, {HIDDEN + 1}) q(j) WHERE t = n"""


@query(sql("bl x", LSTM, "RECURSIVE "))
def lstm_reduce(spark, sf_dir):
    """Of every node, in each batch and layer that samples it, over whole vectors."""
    g = load(spark, sf_dir)
    reduced = A.lstm_reduce(*sampled_coded(g), weights(g.dims, 4 * HIDDEN), weights(HIDDEN, 4 * HIDDEN), by=("batch", "layer"))
    return V.long_form(reduced, ["batch", "layer", "node"])


@query()
def lstm_full_width(spark, sf_dir):
    """As lstm_reduce with as many states as a vector has numbers; its weights are smaller, so that gates stay open."""
    g = load(spark, sf_dir)
    w, u = ([[x / 4 for x in row] for row in weights(g.dims, 4 * g.dims)] for _ in range(2))
    return V.long_form(A.lstm_reduce(*sampled_coded(g), w, u, by=("batch", "layer")), ["batch", "layer", "node"])


@query(sql("inp vs", "SELECT inp.batch, inp.node, vs.total, vs.weighted FROM inp JOIN vs ON vs.node = inp.node"))
def feature_gather(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.sums(A.gather(M.input_nodes(sampled(g, last=False), 1), g.vectors()), ["batch", "node"])


@query(sql("inp vs", "SELECT inp.batch, inp.node, vs.total, vs.weighted FROM inp JOIN vs ON vs.node = inp.node"))
def colocated_gather(spark, sf_dir):
    """The features of a two-hop sample from bucketed tables, of which neither hops nor the gather shuffle edges or vectors."""
    g = load(spark, sf_dir)
    c = colocate(g, int(spark.conf.get("spark.sql.shuffle.partitions")), lists=True)
    blocks = S.sample_blocks(c.adjacency, seeds(g), [10, 5], keep=kept, last=False)
    return V.sums(A.gather(M.input_nodes(blocks, 1), c.features), ["batch", "node"])


@query(sql("e n x", "WITH q AS (SELECT src, dst FROM e UNION ALL SELECT node, node FROM n WHERE node % 2 = 0), t AS (SELECT DISTINCT dst FROM q), u AS (SELECT DISTINCT dst FROM q WHERE src = dst) SELECT t.dst AS node, x.dim::BIGINT AS dim, round(CASE WHEN u.dst IS NULL THEN 0 ELSE x.value END, 6) AS value FROM t LEFT JOIN u ON u.dst = t.dst JOIN x ON x.node = t.dst"))
def self_gather(spark, sf_dir):
    g = load(spark, sf_dir)
    even = g.nodes.where("node % 2 = 0").select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return V.long_form(A.self_gather(g.edges.unionByName(even), g.features, g.dims), ["node"])


@query(sql("s x", "SELECT q.to_part, q.node, x.dim::BIGINT AS dim, round(x.value, 6) AS value FROM (SELECT DISTINCT dst_part AS to_part, dst AS node FROM s WHERE part <> dst_part) q JOIN x ON x.node = q.node"))
def remote_pull(spark, sf_dir):
    g = load(spark, sf_dir)
    wanted = B.shuffle_nodes(split(g)).select("to_part", "node").distinct()
    return V.long_form(A.gather(wanted, g.features), ["to_part", "node"])


# --- layers and models


@query(sql("x", f"WITH {w_table('wt', DIMS, CLASSES)} SELECT x.node, wt.k::BIGINT AS dim, round(greatest(sum(x.value * wt.w), 0), 6) AS value FROM x JOIN wt ON wt.i = x.dim GROUP BY 1, 2"))
def linear_relu(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(L.activate(L.linear(g.features, weights(g.dims, CLASSES))), ["node"])


@query(sql("x", f"WITH {w_table('wt', DIMS, CLASSES)} SELECT x.node AS i, wt.k::BIGINT AS j, round(sum(x.value * wt.w), 6) AS v FROM x JOIN wt ON wt.i = x.dim GROUP BY 1, 2"))
def sparse_matmul(spark, sf_dir):
    g = load(spark, sf_dir)
    x = g.features.select(F.col("node").alias("i"), F.posexplode("vec").alias("k", "v"))
    cells = [(i, k, w) for i, row in enumerate(weights(g.dims, CLASSES)) for k, w in enumerate(row)]
    return L.matmul(x, spark.createDataFrame(cells, "k int, j bigint, v double")).select("i", "j", F.round("v", 6).alias("v"))


LOGITS = w_table("wt", DIMS, CLASSES) + ", z AS (SELECT x.node, wt.k, sum(x.value * wt.w) AS z FROM x JOIN wt ON wt.i = x.dim GROUP BY 1, 2), zs AS (SELECT z.node, z.k, z.z, y.label, max(z.z) OVER (PARTITION BY z.node) AS top FROM z JOIN y ON y.node = z.node), pr AS MATERIALIZED (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY node) AS p FROM zs), ce AS (SELECT node, label, -ln(p) AS loss FROM pr WHERE k = label)"
GRAD = ", gr AS (SELECT node, k, (p - (k = label)::INT) / (SELECT count(*) FROM n) AS g FROM pr)"


def logits(g: G.Graph) -> DataFrame:
    return L.linear(g.features, weights(g.dims, CLASSES))


@query(sql("x y", f"WITH {LOGITS} SELECT node, label, round(loss, 6) AS loss FROM ce"))
def cross_entropy(spark, sf_dir):
    g = load(spark, sf_dir)
    return L.cross_entropy(logits(g), g.labels, CLASSES).select("node", "label", F.round("loss", 6).alias("loss"))


@query(sql("x y o", f"WITH {LOGITS} SELECT round(sum(s) / sum(c), 6) AS mean_loss, round(sum(s / c), 6) AS owner_mean_sum FROM (SELECT sum(loss) AS s, count(*) AS c FROM ce JOIN o ON o.node = ce.node GROUP BY o.part)"))
def loss_reductions(spark, sf_dir):
    g = load(spark, sf_dir)
    return L.losses(L.cross_entropy(logits(g), g.labels, CLASSES), g.owners)


@query(sql("x y", f"WITH {LOGITS}{GRAD} SELECT node, k::BIGINT AS dim, round(g, 9) AS value FROM gr"))
def cross_entropy_gradient(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(L.cross_entropy_gradient(logits(g), g.labels, CLASSES), ["node"], digits=9)


@query(sql("x y", f"WITH {LOGITS}{GRAD} SELECT i, wt.k, round(wt.w - 0.1 * v, 6) AS value FROM (SELECT x.dim AS i, gr.k, sum(x.value * gr.g) AS v FROM x JOIN gr ON gr.node = x.node GROUP BY 1, 2) q JOIN wt USING (i, k)"))
def sgd_step(spark, sf_dir):
    g = load(spark, sf_dir)
    w = weights(g.dims, CLASSES)
    grad = L.weight_gradient(g.features, L.cross_entropy_gradient(logits(g), g.labels, CLASSES), g.dims, CLASSES)
    return L.sgd_step(grad, w, 0.1).select("i", "k", F.round("value", 6).alias("value"))


@query(sql("x y", f"WITH {LOGITS}{GRAD} SELECT i::INT AS i, wt.k::INT AS k, round(wt.w - 0.05 * v / (abs(v) + 1e-8), 6) AS value FROM (SELECT x.dim AS i, gr.k, sum(x.value * gr.g) AS v FROM x JOIN gr ON gr.node = x.node GROUP BY 1, 2) q JOIN wt USING (i, k)"))
def adam_step(spark, sf_dir):
    """One step of the resumable loop, which is started again after it and finds it done."""
    g = load(spark, sf_dir)
    path, x = shared_path(spark, "training"), kept(g.features, "features")
    for _ in range(2):
        state = train(x, g.labels, weights(g.dims, CLASSES), CLASSES, path, 1)
    return state.select("i", "k", F.round("value", 6).alias("value"))


@query(sql("x y", f"WITH {LOGITS}{GRAD} SELECT gr.node, wt.i::BIGINT AS dim, round(sum(gr.g * wt.w), 9) AS value FROM gr JOIN wt ON wt.k = gr.k GROUP BY 1, 2"))
def linear_backward(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(L.linear_backward(L.cross_entropy_gradient(logits(g), g.labels, CLASSES), weights(g.dims, CLASSES)), ["node"], digits=9)


@query(sql("x y", f"WITH {LOGITS} SELECT count(*) AS n, sum((z >= top)::INT)::BIGINT AS n_correct, round(avg((z >= top)::INT), 6) AS accuracy FROM zs WHERE k = label"))
def accuracy(spark, sf_dir):
    g = load(spark, sf_dir)
    return L.accuracy(logits(g), g.labels, CLASSES)


@query(sql("x y", f"WITH {LOGITS}, sp AS (SELECT node, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT node, ('0x' || substr(md5('1:split:' || node), 1, 8))::BIGINT / 4294967296.0 AS u FROM n)) SELECT split, count(*) AS n, sum((z >= top)::INT)::BIGINT AS n_correct, round(avg((z >= top)::INT), 6) AS accuracy FROM zs JOIN sp ON sp.node = zs.node WHERE k = label GROUP BY split"))
def split_accuracy(spark, sf_dir):
    g = load(spark, sf_dir)
    return L.accuracy(logits(g), g.labels, CLASSES, I.random_split(g.nodes))


@query(sql("x", f"WITH {w_table('wa', DIMS, 6)}, {w_table('wb', 6, 4)}, h AS (SELECT x.node, wa.k, greatest(sum(x.value * wa.w), 0) AS v FROM x JOIN wa ON wa.i = x.dim GROUP BY 1, 2) SELECT h.node, wb.k::BIGINT AS dim, round(sum(h.v * wb.w), 6) AS value FROM h JOIN wb ON wb.i = h.k GROUP BY 1, 2"))
def mlp_forward(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(L.mlp(g.features, [g.dims, 6, 4]), ["node"])


@query(sql("a x", f"""WITH {w_table('wa', DIMS, 6)}, {w_table('wb', 6, 4)}, s1 AS (SELECT a.dst AS node, x.dim, sum(x.value) AS v FROM a JOIN x ON x.node = a.src GROUP BY 1, 2),
h AS (SELECT s1.node, wa.k, greatest(sum(s1.v * wa.w), 0) AS v FROM s1 JOIN wa ON wa.i = s1.dim GROUP BY 1, 2), s2 AS (SELECT a.dst AS node, h.k AS dim, sum(h.v) AS v FROM a JOIN h ON h.node = a.src GROUP BY 1, 2)
SELECT s2.node, wb.k::BIGINT AS dim, round(sum(s2.v * wb.w), 5) AS value FROM s2 JOIN wb ON wb.i = s2.dim GROUP BY 1, 2"""))
def gcn_forward(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(L.gcn_sum(kept(whole_block(g), "block"), g.features, [g.dims, 6, 4], keep=kept), ["node"], digits=5)


SAGE = """{w1}, {w2}, m1 AS (SELECT a.dst AS node, x.dim, avg(x.value) AS v FROM a JOIN x ON x.node = a.src GROUP BY 1, 2),
c1 AS (SELECT node, dim, value AS v FROM x UNION ALL SELECT node, dim + {dims}, v FROM m1), h1 AS (SELECT c1.node, wa.k AS dim, greatest(sum(c1.v * wa.w), 0) AS v FROM c1 JOIN wa ON wa.i = c1.dim GROUP BY 1, 2),
m2 AS (SELECT a.dst AS node, h1.dim, avg(h1.v) AS v FROM a JOIN h1 ON h1.node = a.src GROUP BY 1, 2), c2 AS (SELECT node, dim, v FROM h1 UNION ALL SELECT node, dim + 6, v FROM m2)
SELECT c2.node, wb.k::BIGINT AS dim, round(sum(c2.v * wb.w), 6) AS value FROM c2 JOIN wb ON wb.i = c2.dim GROUP BY 1, 2""".format(w1=w_table("wa", 2 * DIMS, 6), w2=w_table("wb", 12, 4), dims=DIMS)


@query(sql("a x", "WITH " + SAGE))
def full_inference(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(L.full_inference(kept(g.edges, "edges"), g.nodes, g.features, [g.dims, 6, 4], keep=kept), ["node"])


@query(sql("sa o x", f"WITH {w_table('wa', 2 * DIMS, 4)}, {PAIRWISE}, c AS (SELECT node, dim, value AS v FROM x UNION ALL SELECT node, dim + {DIMS}, value FROM pw) SELECT c.node, wa.k::BIGINT AS dim, round(sum(c.v * wa.w), 6) AS value FROM c JOIN wa ON wa.i = c.dim GROUP BY 1, 2"))
def split_sage_layer(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(L.sage([kept(whole_split(g), "split")], g.features, [g.dims, 4], "pairwise", g.owners), ["node"])


def pairwise_layer(n: int, x: str, dims: int, out: int, activation: bool) -> str:
    """h{n} (node, dim, value): concat(own, pairwise mean) W of the rows of x (node, dim, value)."""
    value = "greatest(sum(c.v * w.w), 0)" if activation else "sum(c.v * w.w)"
    return f"""{w_table(f'w{n}', 2 * dims, out)}, p{n} AS (SELECT sa.dst, sa.part, x.dim, avg(x.value) AS m FROM sa JOIN {x} x ON x.node = sa.src GROUP BY 1, 2, 3),
r{n} AS (SELECT p.*, p.part = o.part AS own, row_number() OVER (PARTITION BY p.dst, p.dim, p.part = o.part ORDER BY p.part) AS j, count(*) OVER (PARTITION BY p.dst, p.dim) - 1 AS k FROM p{n} p JOIN o ON o.node = p.dst),
c{n} AS (SELECT node, dim, value AS v FROM {x} UNION ALL SELECT dst, dim + {dims}, sum(CASE WHEN own THEN m / 2.0 ** k ELSE m / 2.0 ** (k - j + 1) END) FROM r{n} GROUP BY 1, 2),
h{n} AS MATERIALIZED (SELECT c.node, w.k AS dim, {value} AS value FROM c{n} c JOIN w{n} w ON w.i = c.dim GROUP BY 1, 2)"""


@query(sql("sa o x", f"WITH {pairwise_layer(1, 'x', DIMS, 6, True)}, {pairwise_layer(2, 'h1', 6, 6, True)}, {pairwise_layer(3, 'h2', 6, 4, False)} SELECT node, dim::BIGINT AS dim, round(value, 6) AS value FROM h3"))
def split_sage_three_layers(spark, sf_dir):
    g = load(spark, sf_dir)
    block = kept(whole_split(g), "split")
    return V.long_form(L.sage([block] * 3, g.features, [g.dims, 6, 6, 4], "pairwise", g.owners, keep=kept), ["node"])


# --- metrics


@query(sql("inp o", "SELECT count(*) AS inputs, sum((o.part <> inp.batch % 4)::INT)::BIGINT AS moved, round(avg((o.part <> inp.batch % 4)::INT), 6) AS ratio FROM inp JOIN o ON o.node = inp.node"))
def naive_movement(spark, sf_dir):
    g = load(spark, sf_dir)
    return M.naive_movement(M.input_nodes(sampled(g), 1), g.owners)


@query(sql("s inp", "WITH c AS (SELECT * FROM s WHERE src_part <> dst_part), q AS (SELECT (SELECT count(*) FROM c) AS cut_edges, (SELECT count(*) FROM (SELECT DISTINCT batch, layer, src_part, dst FROM c)) AS cut_nodes, (SELECT count(*) FROM inp) AS inputs) SELECT *, round(cut_edges / inputs, 6) AS edge_ratio, round(cut_nodes / inputs, 6) AS node_ratio FROM q"))
def cross_communication(spark, sf_dir):
    g = load(spark, sf_dir)
    return M.cross_communication(split(g), 1)


OWN = "w AS (SELECT DISTINCT batch % 4 AS part, layer, dst AS node FROM bl WHERE layer >= 1)"


@query(sql("bl", f"WITH {OWN}, p AS (SELECT count(*) AS c FROM w a JOIN w b ON a.layer = b.layer AND a.node = b.node AND a.part < b.part) SELECT c AS common, (SELECT count(*) FROM w) AS computed, round(c / (SELECT count(*) FROM w), 6) AS ratio FROM p"))
def redundancy(spark, sf_dir):
    return M.redundancy(sampled(load(spark, sf_dir)))


@query(sql("bl", f"WITH {OWN} SELECT a.layer, a.part AS a, b.part AS b, count(*) AS common FROM w a JOIN w b ON a.layer = b.layer AND a.node = b.node AND a.part < b.part GROUP BY 1, 2, 3"))
def pair_redundancy(spark, sf_dir):
    return M.pair_redundancy(sampled(load(spark, sf_dir)))


@query(sql("s", "SELECT max(c) AS most, min(c) AS least, round((max(c) - min(c)) / min(c), 6) AS skew FROM (SELECT count(*) AS c FROM s GROUP BY part)"))
def work_skew(spark, sf_dir):
    return M.work_skew(split(load(spark, sf_dir)))


@query(sql("s", "WITH ow AS (SELECT layer, count(*) AS owned FROM (SELECT DISTINCT batch, layer, dst_part, dst FROM s) GROUP BY 1), sh AS (SELECT layer, count(*) AS shuffled FROM (SELECT DISTINCT batch, layer, part, dst_part, dst FROM s WHERE part <> dst_part) GROUP BY 1) SELECT layer, owned, coalesce(shuffled, 0) AS shuffled, round(coalesce(shuffled, 0) / owned, 6) AS ratio FROM ow LEFT JOIN sh USING (layer)"))
def shuffle_ratio(spark, sf_dir):
    rows = kept(split(load(spark, sf_dir)), "split")
    return M.shuffle_ratio(B.owned_nodes(rows), B.shuffle_nodes(rows))


@query(sql("s", "SELECT coalesce(layer, -1)::INT AS layer, coalesce(part, -1)::INT AS part, count(*) AS edges, sum((part <> dst_part)::INT)::BIGINT AS cut FROM (SELECT layer, part, part AS p, dst_part FROM s) GROUP BY ROLLUP (layer, part)".replace("sum((part <> dst_part)", "sum((p <> dst_part)")))
def movement_by_part(spark, sf_dir):
    rows = split(load(spark, sf_dir))
    return rows.rollup("layer", "part").agg(F.count("*").alias("edges"), F.sum(F.when(F.col("src_part") != F.col("dst_part"), 1).otherwise(0)).cast("bigint").alias("cut")).select(F.coalesce(F.col("layer"), F.lit(-1)).cast("int").alias("layer"), F.coalesce(F.col("part"), F.lit(-1)).cast("int").alias("part"), "edges", "cut")


@query("SELECT round(avg(s), 6) AS mean, count(*) AS epochs FROM (SELECT user_id % 10 AS epoch, sum(value) AS s FROM events GROUP BY 1) WHERE epoch > 0")
def epoch_means(spark, sf_dir):
    rows = G.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("epoch")).agg(F.sum("value").alias("s"))
    return M.epoch_means(rows, "s")


@query("SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1")
def run_lengths(spark, sf_dir):
    return M.run_lengths(G.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("value")))


@query("SELECT user_id AS grp, event_id AS pos, event_type AS value FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type AND event_type IS NOT NULL")
def value_changes(spark, sf_dir):
    return M.changes(G.table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("pos"), F.col("event_type").alias("value")))


# --- more of samples, splits and models


@query(sql("l0 l1 l2 o", "SELECT b.layer, p.part AS src_part, q.part AS dst_part, count(*) AS edges, sum(b.src)::BIGINT AS src_sum FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) b JOIN o p ON p.node = b.src JOIN o q ON q.node = b.dst GROUP BY 1, 2, 3"))
def sample_three_hops(spark, sf_dir):
    g = load(spark, sf_dir)
    blocks = S.sample_blocks(S.adjacency(kept(g.edges, "edges"), kept, owners=g.owners), seeds(g), [10, 5, 3], keep=kept, last=False)
    return B.split_blocks(blocks, g.owners).groupBy("layer", "src_part", "dst_part").agg(F.count("*").alias("edges"), F.sum("src").alias("src_sum"))


@query(sql("f0 d near o", f"WITH {COOPERATIVE} SELECT * FROM c0 UNION ALL {cooperative_sql('q1', 1, 5)}"))
def cooperative_hops(spark, sf_dir):
    g = load(spark, sf_dir)
    return S.cooperative_blocks(g.edges, seeds(g), g.owners, [10, 5], keep=kept)


@query(sql("e o n", f"""WITH w AS (SELECT p.part, e.src, e.dst FROM e JOIN o p ON p.node = e.src JOIN o q ON q.node = e.dst WHERE p.part = q.part),
wg AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS i FROM w), wd AS (SELECT dst AS node, count(*) AS deg FROM w GROUP BY 1),
wp AS (SELECT o.part, o.node, unnest({floyd_sql(3, "o.part::VARCHAR, '0', o.node::VARCHAR")}) AS i FROM o JOIN wd d ON d.node = o.node)
SELECT wp.part::BIGINT AS part, wg.dst, wg.src FROM wp JOIN wg ON wg.dst = wp.node AND wg.i = wp.i UNION ALL SELECT part, node, node FROM o"""))
def owner_samples(spark, sf_dir):
    g = load(spark, sf_dir)
    return S.owner_samples(g.edges, g.owners, 3)


@query(sql("n", "SELECT epoch::INT AS epoch, rank // 100 AS batch, node, rank FROM (SELECT epoch, node, (row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws(':', '1', epoch::VARCHAR, node::VARCHAR)), node) - 1)::BIGINT AS rank FROM n, range(3) t(epoch))"))
def epoch_batches(spark, sf_dir):
    return S.epoch_batches(load(spark, sf_dir).nodes, 100, 3)


@query(sql("s", "SELECT layer, part, CASE WHEN src = dst THEN 'self' WHEN src_part = dst_part THEN 'local' ELSE 'remote' END AS kind, count(*) AS edges FROM s GROUP BY 1, 2, 3"))
def split_markers(spark, sf_dir):
    return B.markers(split(load(spark, sf_dir))).groupBy("layer", "part", "kind").agg(F.count("*").alias("edges"))


@query(sql("e o", "SELECT 0 AS layer, a::INT AS src_part, b::INT AS dst_part, (SELECT count(*) FROM e JOIN o p ON p.node = e.src JOIN o q ON q.node = e.dst WHERE p.part = a AND q.part = b) AS edges FROM range(6) t(a), range(6) u(b)"))
def full_grid(spark, sf_dir):
    """All edges, and two owners more than occur, whose cells are empty."""
    g = load(spark, sf_dir)
    return B.full_grid(O.with_owners(g.edges.withColumn("layer", F.lit(0)), g.owners), 6)


@query(sql("s", """WITH m AS MATERIALIZED (SELECT batch, layer, part, node, (row_number() OVER (PARTITION BY batch, layer, part ORDER BY node) - 1)::BIGINT AS id FROM (SELECT batch, layer, part, src AS node FROM s UNION SELECT batch, layer, part, dst FROM s))
SELECT s.batch, s.layer, s.part, a.id AS src_id, b.id AS dst_id FROM s JOIN m a ON a.batch = s.batch AND a.layer = s.layer AND a.part = s.part AND a.node = s.src JOIN m b ON b.batch = s.batch AND b.layer = s.layer AND b.part = s.part AND b.node = s.dst"""))
def relabelled_edges(spark, sf_dir):
    return B.relabel(split(load(spark, sf_dir)))


@query(sql("s", """WITH q AS (SELECT batch, layer, part, src, dst, row(dst, (src <> dst)::INT, src) AS pos FROM s),
i AS (SELECT batch, layer, part, src, row_number() OVER (PARTITION BY batch, layer, part ORDER BY min(pos)) - 1 AS in_id FROM q GROUP BY 1, 2, 3, 4),
o_ AS (SELECT batch, layer, part, dst, row_number() OVER (PARTITION BY batch, layer, part ORDER BY min(pos)) - 1 AS out_id FROM q GROUP BY 1, 2, 3, 4)
SELECT batch, layer, part, count(*) AS edges, sum(in_id * (1 + out_id % 7))::BIGINT AS id_sum, max(in_id)::BIGINT AS last_in, max(out_id)::BIGINT AS last_out FROM s JOIN i USING (batch, layer, part, src) JOIN o_ USING (batch, layer, part, dst) GROUP BY 1, 2, 3"""))
def encountered_edges(spark, sf_dir):
    rows = B.encountered(split(load(spark, sf_dir)))
    return rows.groupBy("batch", "layer", "part").agg(F.count("*").alias("edges"), F.sum(F.col("in_id") * (1 + F.col("out_id") % 7)).alias("id_sum"), F.max("in_id").alias("last_in"), F.max("out_id").alias("last_out"))


@query(sql("n d o s", f"""WITH {PARTED.format(c=0.1)}, h AS (SELECT part, node, slot FROM (SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY deg DESC, node) - 1 AS slot FROM g) WHERE slot < (SELECT size FROM z)),
r AS (SELECT DISTINCT s.batch, s.part, s.src AS node FROM s WHERE layer = 1),
k AS (SELECT r.*, h.slot, h.slot IS NOT NULL AS cached FROM r LEFT JOIN h ON h.part = r.part AND h.node = r.node)
SELECT batch, part, node, (CASE WHEN cached THEN slot ELSE (SELECT count(*) FROM h WHERE h.part = k.part) + row_number() OVER (PARTITION BY batch, part, cached ORDER BY node) - 1 END)::BIGINT AS local_id, cached FROM k"""))
def input_slots(spark, sf_dir):
    g = load(spark, sf_dir)
    return B.input_ids(split(g), C.partition_cache(g.edges, g.nodes, g.owners, 0.1), 1)


@query(sql("s", """WITH c AS (SELECT batch, layer, part, count(*) AS edges, sum((src = dst)::INT)::BIGINT AS self_edges, count(DISTINCT src) AS in_nodes, count(DISTINCT dst) AS out_nodes, count(DISTINCT CASE WHEN part = dst_part THEN dst END) AS owned FROM s GROUP BY 1, 2, 3),
r AS (SELECT batch, layer, dst_part AS part, count(*) AS received FROM (SELECT DISTINCT batch, layer, dst_part, part, dst FROM s WHERE part <> dst_part) GROUP BY 1, 2, 3)
SELECT batch, layer, part, coalesce(edges, 0) AS edges, coalesce(self_edges, 0) AS self_edges, coalesce(in_nodes, 0) AS in_nodes, coalesce(out_nodes, 0) AS out_nodes, coalesce(owned, 0) AS owned, coalesce(received, 0) AS received FROM c FULL JOIN r USING (batch, layer, part)"""))
def sample_counts(spark, sf_dir):
    return B.sample_counts(split(load(spark, sf_dir)))


@query(sql("s", """WITH mv AS (SELECT DISTINCT batch, layer, part, dst_part, dst FROM s WHERE part <> dst_part),
al AS (SELECT layer, part, 'edge' AS kind, -1 AS peer, src, dst FROM s UNION ALL SELECT layer, dst_part, 'owned', -1, NULL, dst FROM (SELECT DISTINCT batch, layer, dst_part, dst FROM s)
UNION ALL SELECT layer, part, 'to', dst_part, NULL, dst FROM mv UNION ALL SELECT layer, dst_part, 'from', part, NULL, dst FROM mv)
SELECT layer, part, kind, peer, count(*) AS n, sum(dst)::BIGINT AS dst_sum, coalesce(sum(src), 0)::BIGINT AS src_sum FROM al GROUP BY 1, 2, 3, 4"""))
def model_input(spark, sf_dir):
    rows = B.model_input(kept(split(load(spark, sf_dir)), "split"))
    return rows.groupBy("layer", "part", "kind", "peer").agg(F.count("*").alias("n"), F.sum("dst").alias("dst_sum"), F.coalesce(F.sum("src"), F.lit(0)).alias("src_sum"))


@query(sql("vs o", "SELECT o.node, o.part, vs.total, vs.weighted FROM vs JOIN o ON o.node = vs.node"))
def scatter_gather(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.sums(O.scatter(g.features, g.owners), ["node", "part"])


@query(sql("x y o", f"""SELECT (SELECT round(sum(value), 4) FROM x) AS csum_features, 0::BIGINT AS bad_features, (SELECT sum(label)::BIGINT FROM y) AS csum_labels,
(SELECT count(*) FROM y WHERE label IS NULL OR label NOT BETWEEN 0 AND {CLASSES - 1}) AS bad_labels, (SELECT sum(part)::BIGINT FROM o) AS csum_owners, 0::BIGINT AS bad_owners"""))
def range_checks(spark, sf_dir):
    g = load(spark, sf_dir)
    return I.range_checks(g.features, g.labels, g.owners, g.dims, CLASSES, 4)


@query(sql("e x", f"WITH {w_table('wt', DIMS, 8)}, p AS (SELECT x.node, wt.k, greatest(sum(x.value * wt.w), 0) AS v FROM x JOIN wt ON wt.i = x.dim GROUP BY 1, 2) SELECT e.dst AS node, p.k::BIGINT AS dim, round(max(p.v), 6) AS value FROM e JOIN p ON p.node = e.src GROUP BY 1, 2"))
def max_pool(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(A.max_pool(g.edges, g.features, weights(g.dims, 8)), ["node"])


@query(sql("e x", f"""WITH {w_table('wt', DIMS, 4)}, lr AS (SELECT node, k // 2 AS h, sum(CASE WHEN k % 2 = 0 THEN value * w END) AS l, sum(CASE WHEN k % 2 = 1 THEN value * w END) AS r FROM x JOIN wt ON wt.i = x.dim GROUP BY 1, 2),
q AS (SELECT e.src, e.dst, p.h, CASE WHEN p.l + q.r > 0 THEN p.l + q.r ELSE 0.2 * (p.l + q.r) END AS s FROM e JOIN lr p ON p.node = e.src JOIN lr q ON q.node = e.dst AND q.h = p.h),
al AS (SELECT src, dst, h, exp(s - max(s) OVER (PARTITION BY dst, h)) AS v FROM q), alpha AS (SELECT src, dst, h, v / sum(v) OVER (PARTITION BY dst, h) AS alpha FROM al)
SELECT a.dst AS node, (a.h * {DIMS} + x.dim)::BIGINT AS dim, round(sum(a.alpha * x.value), 6) AS value FROM alpha a JOIN x ON x.node = a.src GROUP BY 1, 2"""))
def multi_head_attention(spark, sf_dir):
    g = load(spark, sf_dir)
    w = weights(g.dims, 4)
    return V.long_form(A.multi_head_attention(g.edges, g.vectors(), g.dims, [([r[2 * k] for r in w], [r[2 * k + 1] for r in w]) for k in range(2)]), ["node"])


@query(sql("x", f"WITH {w_table('wt', DIMS, CLASSES)}, {w_table('bt', 1, CLASSES)} SELECT x.node, wt.k::BIGINT AS dim, round(greatest(sum(x.value * wt.w) + any_value(bt.w), 0), 6) AS value FROM x JOIN wt ON wt.i = x.dim JOIN bt ON bt.k = wt.k GROUP BY 1, 2"))
def linear_bias(spark, sf_dir):
    g = load(spark, sf_dir)
    return V.long_form(L.activate(L.linear(g.features, weights(g.dims, CLASSES), weights(1, CLASSES)[0])), ["node"])


@query(sql("x y", f"WITH {LOGITS}{GRAD} SELECT gr.node, gr.k::BIGINT AS dim, round(CASE WHEN pr.z <= 0 THEN 0 ELSE gr.g END, 9) AS value FROM gr JOIN pr ON pr.node = gr.node AND pr.k = gr.k"))
def relu_backward(spark, sf_dir):
    g = load(spark, sf_dir)
    z = logits(g)
    return V.long_form(L.relu_backward(L.activate(z), L.cross_entropy_gradient(z, g.labels, CLASSES).select("node", "vec")), ["node"], digits=9)


STEP = f"""{w_table('wa', DIMS, 6)}, {w_table('ba', 1, 6)}, {w_table('wb', 6, CLASSES)}, {w_table('bb', 1, CLASSES)}, s1 AS ({{s1}}),
h AS (SELECT s1.node, wa.k, greatest(sum(s1.v * wa.w) + any_value(ba.w), 0) AS v FROM s1 JOIN wa ON wa.i = s1.dim JOIN ba ON ba.k = wa.k GROUP BY 1, 2), s2 AS ({{s2}}),
z AS (SELECT s2.node, wb.k, sum(s2.v * wb.w) + any_value(bb.w) AS z FROM s2 JOIN wb ON wb.i = s2.dim JOIN bb ON bb.k = wb.k GROUP BY 1, 2),
pr AS (SELECT z.node, z.k, y.label, exp(z - max(z) OVER (PARTITION BY z.node)) AS x FROM z JOIN y ON y.node = z.node),
g2 AS (SELECT node, k, (x / sum(x) OVER (PARTITION BY node) - (k = label)::INT) / (SELECT count(DISTINCT node) FROM z) AS g FROM pr),
bk AS (SELECT g2.node, wb.i AS k, sum(g2.g * wb.w) AS g FROM g2 JOIN wb ON wb.k = g2.k GROUP BY 1, 2), bs AS ({{back}}),
g1 AS (SELECT bs.node, bs.k, CASE WHEN h.v <= 0 THEN 0 ELSE bs.g END AS g FROM bs JOIN h ON h.node = bs.node AND h.k = bs.k),
d AS (SELECT 'w1' AS param, s1.dim AS i, g1.k, sum(s1.v * g1.g) AS v FROM s1 JOIN g1 ON g1.node = s1.node GROUP BY 2, 3 UNION ALL SELECT 'w2', s2.dim, g2.k, sum(s2.v * g2.g) FROM s2 JOIN g2 ON g2.node = s2.node GROUP BY 2, 3
UNION ALL SELECT 'b1', 0, k, sum(g) FROM g1 GROUP BY k UNION ALL SELECT 'b2', 0, k, sum(g) FROM g2 GROUP BY k)
SELECT param, i::BIGINT AS i, k::BIGINT AS k, round(((i * 7 + k * 3) % 11 - 5) / 10.0 - 0.1 * v, 5) AS value FROM d"""


@query(sql("x y", "WITH " + STEP.format(s1="SELECT node, dim, value AS v FROM x", s2="SELECT node, k AS dim, v FROM h", back="SELECT node, k, g FROM bk")))
def mlp_step(spark, sf_dir):
    g = load(spark, sf_dir)
    return L.two_layer_step(g.features, g.labels, (g.dims, 6, CLASSES), 0.1, keep=kept).select("param", "i", "k", F.round("value", 5).alias("value"))


@query(sql("a x y", "WITH " + STEP.format(s1="SELECT a.dst AS node, x.dim, sum(x.value) AS v FROM a JOIN x ON x.node = a.src GROUP BY 1, 2", s2="SELECT a.dst AS node, h.k AS dim, sum(h.v) AS v FROM a JOIN h ON h.node = a.src GROUP BY 1, 2", back="SELECT a.src AS node, bk.k, sum(bk.g) AS g FROM a JOIN bk ON bk.node = a.dst GROUP BY 1, 2")))
def gcn_step(spark, sf_dir):
    g = load(spark, sf_dir)
    return L.two_layer_step(g.features, g.labels, (g.dims, 6, CLASSES), 0.1, kept(whole_block(g), "block"), keep=kept).select("param", "i", "k", F.round("value", 5).alias("value"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: two hops sampled from all nodes in batches, split over 4 owners, edges by (layer, source owner, destination owner)."""
    return QUERIES["split_counts"](spark, sf_dir)
