"""Neighbour aggregation: messages along edges, reduced at their destinations; split over source owners and merged.

Vectors aggregate as scalar columns, so Spark sums them before the shuffle; a node of any degree is never collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions import vectors as V
from hopweave.sources.graphs import Coded

MESSAGES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "copy_u": lambda u, v, e: u,
    "u_mul_v": lambda u, v, e: V.times(u, v),
    "u_add_v": lambda u, v, e: V.plus(u, v),
    "u_mul_e": lambda u, v, e: V.scale(u, e),
}
REDUCES = {"sum": F.sum, "mean": F.avg, "max": F.max}


def coded_ends(block: DataFrame, codes: DataFrame, both: bool) -> DataFrame:
    """block with _c (and _d), the codes of its sources (and destinations), all edges of a destination in one task: a row of a few
    numbers an edge, and none of what is summed there afterwards is sent again."""
    rows = block.join(codes.select(F.col("node").alias("src"), F.col("code").alias("_c")), "src")
    if both:
        return rows.join(codes.select(F.col("node").alias("dst"), F.col("code").alias("_d")), "dst").repartition("dst")
    return rows.repartition("dst")


def messages(block: DataFrame, h: DataFrame | Coded, message: str | Callable = "copy_u", weight: str | None = None) -> DataFrame:
    """block with msg; h is (node, vec), or codes and a book: then codes travel, and vectors are looked up where a destination's
    edges have met. Only messages that need the destination join it."""
    make, both = MESSAGES[message] if isinstance(message, str) else message, message not in ("copy_u", "u_mul_e")
    e = F.col(weight) if weight else F.lit(1.0)
    if isinstance(h, Coded):
        rows = coded_ends(block, h.codes, both).join(F.broadcast(h.book.select(F.col("code").alias("_c"), F.col("vec").alias("_u"))), "_c")
        rows = rows.join(F.broadcast(h.book.select(F.col("code").alias("_d"), F.col("vec").alias("_v"))), "_d") if both else rows
        rows = rows if both else rows.withColumn("_v", F.lit(None).cast("array<double>"))
        return rows.withColumn("msg", make(F.col("_u"), F.col("_v"), e)).drop("_u", "_v", "_c", "_d")
    rows = block.join(h.select(F.col("node").alias("src"), F.col("vec").alias("_u")), "src")
    if both:
        rows = rows.join(h.select(F.col("node").alias("dst"), F.col("vec").alias("_v")), "dst")
    else:
        rows = rows.withColumn("_v", F.lit(None).cast("array<double>"))
    return rows.withColumn("msg", make(F.col("_u"), F.col("_v"), e)).drop("_u", "_v")


def aggregate_neighbors(block: DataFrame, h: DataFrame, dims: int, message: str | Callable = "copy_u", reduce: str = "sum", weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., node, vec for each destination of the block; repeated edges count each time."""
    rows = messages(block, h, message, weight)
    return rows.groupBy(*by, F.col("dst").alias("node")).agg(V.aggregate(REDUCES[reduce], F.col("msg"), dims).alias("vec"))


def with_empty(out: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """A row of zeros for nodes without in-edges."""
    return nodes.join(out, "node", "left").select("node", F.coalesce("vec", V.zeros(dims)).alias("vec"))


def sum_gradient(block: DataFrame, grad: DataFrame, dims: int) -> DataFrame:
    """Gradient of the sum for its sources: the sum over reversed edges."""
    return aggregate_neighbors(block.select(F.col("dst").alias("src"), F.col("src").alias("dst")), grad, dims)


def gcn(block: DataFrame, h: DataFrame, dims: int) -> DataFrame:
    """(sum of sources + own) / (degree + 1)."""
    rows = messages(block, h)
    out = rows.groupBy("dst").agg(V.aggregate(F.sum, F.col("msg"), dims).alias("s"), F.count("*").alias("deg"))
    own = h.select(F.col("node").alias("dst"), F.col("vec").alias("own"))
    return out.join(own, "dst").select(F.col("dst").alias("node"), V.scale(V.plus(F.col("s"), F.col("own")), 1 / (F.col("deg") + 1)).alias("vec"))


#: Salts that a destination's edges are dealt over, and the width of a band of scores: exp stays finite within one.
SALTS, BAND = 8, 64.0
Head = tuple[list[float], list[float]]


def scored(block: DataFrame, h: DataFrame | Coded, heads: list[Head], salts: int = SALTS, vectors: bool = True) -> DataFrame:
    """src, dst, salt, s0, s1, ... (and vec of the source): leaky_relu(left . h[src] + right . h[dst]) of each head, on edges that
    meet their destination by (dst, salt), so a hub's in-edges are dealt over that many tasks at least. With codes and a book edges
    meet by their destination, as pairs of codes."""
    if isinstance(h, Coded):
        l = h.book.select(F.col("code").alias("_c"), *(["vec"] if vectors else []), *[V.dot(F.col("vec"), a).alias(f"_l{k}") for k, (a, _) in enumerate(heads)])
        r = h.book.select(F.col("code").alias("_d"), *[V.dot(F.col("vec"), b).alias(f"_r{k}") for k, (_, b) in enumerate(heads)])
        rows = coded_ends(block.select("src", "dst"), h.codes, True).join(F.broadcast(l), "_c").join(F.broadcast(r), "_d")
        return rows.select("src", "dst", F.lit(0).alias("salt"), *(["vec"] if vectors else []), *[V.leaky_relu(F.col(f"_l{k}") + F.col(f"_r{k}")).alias(f"s{k}") for k in range(len(heads))])
    l = h.select(F.col("node").alias("src"), *(["vec"] if vectors else []), *[V.dot(F.col("vec"), a).alias(f"_l{k}") for k, (a, _) in enumerate(heads)])
    r = h.select(F.col("node").alias("dst"), *[V.dot(F.col("vec"), b).alias(f"_r{k}") for k, (_, b) in enumerate(heads)])
    r = r.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    rows = block.select("src", "dst").join(l, "src").withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(salts)).cast("int"))
    rows = rows.join(r, ["dst", "salt"])
    return rows.select("src", "dst", "salt", *(["vec"] if vectors else []), *[V.leaky_relu(F.col(f"_l{k}") + F.col(f"_r{k}")).alias(f"s{k}") for k in range(len(heads))])


def softmax_states(rows: DataFrame, heads: int, dims: int = 0) -> DataFrame:
    """dst, and for each head k: top_k, t_k (and v_k): the sum over the in-edges of exp(s - BAND * top), and of exp(...) * vec.

    A state is (band, sum of exp(s - BAND * band), weighted vector), band = floor(s / BAND). States of one band are added up as
    scalars, before the shuffle; those of a destination, as many as its salts and bands, are brought to its largest band.
    """
    n = range(heads)
    rows = rows.select("*", *[F.floor(F.col(f"s{k}") / BAND).alias(f"b{k}") for k in n])
    rows = rows.select("*", *[F.exp(F.col(f"s{k}") - F.lit(BAND) * F.col(f"b{k}")).alias(f"x{k}") for k in n])
    vectors = [V.aggregate(F.sum, V.scale(F.col("vec"), F.col(f"x{k}")), dims).alias(f"v{k}") for k in n] if dims else []
    states = rows.groupBy("dst", "salt", *[f"b{k}" for k in n]).agg(*[F.sum(f"x{k}").alias(f"t{k}") for k in n], *vectors)
    parts = [c for k in n for c in (f"b{k}", f"t{k}", *([f"v{k}"] if dims else []))]
    merged = states.groupBy("dst").agg(*[F.max(f"b{k}").alias(f"top{k}") for k in n], F.collect_list(F.struct(*parts)).alias("_p"))

    def at_top(k: int) -> list[Column]:
        scale = lambda p: F.exp(F.lit(BAND) * (p[f"b{k}"] - F.col(f"top{k}")))
        total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p[f"t{k}"] * scale(p)).alias(f"t{k}")
        vector = F.aggregate("_p", V.zeros(dims), lambda a, p: F.zip_with(a, p[f"v{k}"], lambda x, y: x + y * scale(p))).alias(f"v{k}") if dims else None
        return [F.col(f"top{k}"), total, *([vector] if dims else [])]

    out = ["dst", *[c for k in n for c in at_top(k)]]
    return merged.select(*out)


def edge_softmax(block: DataFrame, h: DataFrame, left: list[float], right: list[float], salts: int = SALTS) -> DataFrame:
    """src, dst, alpha: softmax over each destination's in-edges of leaky_relu(left . h[src] + right . h[dst])."""
    rows = scored(block, h, [(left, right)], salts, vectors=False)
    total = softmax_states(rows, 1).select("dst", (F.lit(BAND) * F.col("top0") + F.log("t0")).alias("_lse"))
    total = total.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return rows.join(total, ["dst", "salt"]).select("src", "dst", F.exp(F.col("s0") - F.col("_lse")).alias("alpha"))


def multi_head_attention(block: DataFrame, h: DataFrame, dims: int, heads: list[Head], salts: int = SALTS) -> DataFrame:
    """node, vec: the attention sums of all heads, one after the other, from one pass over the edges and mergeable states."""
    sums = softmax_states(scored(block, h, heads, salts), len(heads), dims)
    return sums.select(F.col("dst").alias("node"), F.concat(*[V.scale(F.col(f"v{k}"), 1 / F.col(f"t{k}")) for k in range(len(heads))]).alias("vec"))


def max_pool(block: DataFrame, h: DataFrame, w: list[list[float]], b: list[float] | None = None) -> DataFrame:
    """The elementwise largest relu(h W + b) of each destination's sources; the layer runs once a node, not once an edge."""
    pooled = h.select("node", V.relu(V.linear(F.col("vec"), w, b)).alias("vec"))
    return aggregate_neighbors(block, pooled, len(w[0]), reduce="max")


#: Numbers of a padded array that a fold gets at once (64 MB).
FOLD_NUMBERS = 8_000_000


def padded(values, lengths):
    """(places, array [node, step, dim]) of runs of rows, shortest first, each of up to FOLD_NUMBERS numbers; steps beyond a
    node's own are 0."""
    import numpy as np

    order, starts = np.argsort(lengths, kind="stable"), np.concatenate([[0], np.cumsum(lengths)])
    dim, a = values.shape[1], 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * lengths[order[b]] * dim <= FOLD_NUMBERS:
            b += 1
        some = order[a:b]
        n = lengths[some]
        out = np.zeros((len(some), n[-1], dim))
        row = np.repeat(np.arange(len(some)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out[row, step] = values[np.repeat(starts[some], n) + step]
        yield some, out
        a = b


def known_codes(h: Coded) -> DataFrame:
    """node, code of the nodes whose vector is in the book."""
    return h.codes.join(F.broadcast(h.book.select("code")), "code", "left_semi").select("node", "code")


def reduce_with(block: DataFrame, h: DataFrame | Coded, fold: Callable, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., node, vec: an ordered fold of the rows of each destination's sources, in id order.

    fold(x, lengths) gets many destinations at once, as an array [node, step, dim] padded with zeros and the steps of each node,
    and returns an array [node, out]. A destination's sources meet in one row (as codes, with a book): for sampled blocks, whose fan-out bounds them.
    With a book the block may be lists (dst, ends; see sampling.sample_lists) whose parts are codes (known_codes): they are folded as they are.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = isinstance(h, Coded)
    if coded:  # bounded by BOOK_BYTES; ids in order, so that a code is found by bisection
        book = h.book.orderBy("code").toArrow()
        known = book.column("code").to_numpy()
        table = pc.list_flatten(book.column("vec")).to_numpy().reshape(len(known), -1)
        shared = block.sparkSession.sparkContext.broadcast((known, table))

    def task(batches):
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
            inner = pc.list_flatten(rows)
            if not len(inner):
                continue
            if coded:
                known, table = shared.value
                values = table[np.searchsorted(known, inner.to_numpy(zero_copy_only=False))]
            else:
                values = pc.list_flatten(inner).to_numpy(zero_copy_only=False).reshape(len(inner), -1)
            out: list = [None] * len(lengths)
            for some, x in padded(values, lengths):
                for i, v in zip(some.tolist(), np.asarray(fold(x, lengths[some]), float).tolist()):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "vec"])

    kinds = "".join(f"{k} {block.schema[k].dataType.simpleString()}, " for k in by)
    if "ends" in block.columns:
        found = F.transform(F.filter(F.sort_array("ends"), lambda e: e["src_part"].isNotNull()), lambda e: e["src_part"])
        return block.select(*by, F.col("dst").alias("node"), found.alias("_msgs")).where(F.size("_msgs") > 0).mapInArrow(task, f"{kinds}node bigint, vec array<double>")
    if coded:
        sent = block.join(known_codes(h).select(F.col("node").alias("src"), F.col("code").alias("msg")), "src")
    else:
        sent = messages(block, h)
    lists = sent.groupBy(*by, F.col("dst").alias("node")).agg(F.sort_array(F.collect_list(F.struct("src", "msg"))).alias("_rows"))
    return lists.select(*by, "node", F.transform("_rows", lambda x: x["msg"]).alias("_msgs")).mapInArrow(task, f"{kinds}node bigint, vec array<double>")


def attention(block: DataFrame, h: DataFrame, dims: int, left: list[float], right: list[float]) -> DataFrame:
    return multi_head_attention(block, h, dims, [(left, right)])


def partials(split: DataFrame, h: DataFrame, dims: int) -> DataFrame:
    """part, dst, sums, n: each source owner's share of each destination."""
    return messages(split, h).groupBy("part", "dst").agg(V.aggregate(F.sum, F.col("msg"), dims).alias("sums"), F.count("*").alias("n"))


def split_sum(split: DataFrame, h: DataFrame, dims: int) -> DataFrame:
    """Partials by source owner, merged by addition: equals the sum over the whole block."""
    return partials(split, h, dims).groupBy(F.col("dst").alias("node")).agg(V.aggregate(F.sum, F.col("sums"), dims).alias("vec"))


def split_mean(split: DataFrame, h: DataFrame, dims: int) -> DataFrame:
    """Partial sums and counts, merged: the exact mean."""
    out = partials(split, h, dims).groupBy(F.col("dst").alias("node")).agg(V.aggregate(F.sum, F.col("sums"), dims).alias("s"), F.sum("n").alias("n"))
    return out.select("node", V.scale(F.col("s"), 1 / F.col("n")).alias("vec"))


def pairwise_mean(split: DataFrame, h: DataFrame, owners: DataFrame, dims: int) -> DataFrame:
    """Starts at the owner's own partial mean and halves the distance to every other owner's, by ascending part: not the mean.

    A node has as many partials as there are owners at most, so its list is bounded.
    """
    rows = partials(split, h, dims).join(owners.select(F.col("node").alias("dst"), F.col("part").alias("own_part")), "dst")
    rows = rows.withColumn("m", V.scale(F.col("sums"), 1 / F.col("n")))
    per = rows.groupBy("dst").agg(F.max(F.when(F.col("part") == F.col("own_part"), F.col("m"))).alias("own"), F.array_sort(F.collect_list(F.when(F.col("part") != F.col("own_part"), F.struct("part", "m")))).alias("others"))
    merged = F.aggregate("others", F.col("own"), lambda a, x: F.zip_with(a, x["m"], lambda p, q: (p + q) / 2))
    return per.where("own is not null").select(F.col("dst").alias("node"), merged.alias("vec"))


def lstm_reduce(block: DataFrame, h: DataFrame, w: list[list[float]], u: list[list[float]], by: tuple[str, ...] = ()) -> DataFrame:
    """by..., node, vec: the last state of an LSTM cell over each destination's sources in id order.

    w and u are the weights of inputs and states, for four gates (in, forget, out, candidate) side by side. The inputs' share of
    the gates is taken once a node if that makes shorter rows, not once an edge.
    """
    import numpy as np

    hidden, first = len(u), len(w[0]) < len(w)
    inputs, states = np.array(w), np.array(u)

    def fold(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        gates = x if first else x @ inputs
        state, cell = np.zeros((len(x), hidden)), np.zeros((len(x), hidden))
        for t in range(gates.shape[1]):
            on = slice(int(np.searchsorted(lengths, t, side="right")), None)  # shortest first: the rest has no such step
            i, f, o, g = np.split(gates[on, t] + state[on] @ states, 4, axis=1)
            cell[on] = cell[on] / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
            state[on] = np.tanh(cell[on]) / (1 + np.exp(-o))
        return state

    if isinstance(h, Coded) and first:
        h = Coded(h.codes, h.book.select("code", V.linear(F.col("vec"), w).alias("vec")))
    elif first:
        h = h.select("node", V.linear(F.col("vec"), w).alias("vec"))
    return reduce_with(block, h, fold, by)


# --- moving rows


def gather(inputs: DataFrame, features: DataFrame | Coded) -> DataFrame:
    """inputs with vec; with codes and a book inputs meet their codes, and vectors are looked up where they are used."""
    if isinstance(features, Coded):
        return inputs.join(features.codes, "node").join(F.broadcast(features.book), "code").drop("code")
    return inputs.join(features, "node")


def self_gather(block: DataFrame, h: DataFrame, dims: int) -> DataFrame:
    """Each destination's own row if the block has its self edge, zeros otherwise; repeated self edges count once."""
    dsts = block.groupBy(F.col("dst").alias("node")).agg(F.max((F.col("src") == F.col("dst"))).alias("_own"))
    return dsts.join(h, "node", "left").select("node", F.when(F.col("_own"), F.coalesce("vec", V.zeros(dims))).otherwise(V.zeros(dims)).alias("vec"))


def require_all(wanted: DataFrame, found: DataFrame, what: str) -> DataFrame:
    """found, checked to have every wanted node."""
    missing = wanted.select("node").join(found.select("node"), "node", "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"{what}: a node is missing")
    return found


def require_min_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, all of which must have an in-edge."""
    return require_all(nodes, nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi"), "in-degree of zero")
