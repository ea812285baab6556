"""Dense layers, losses, gradients and small models over (node, vec) tables. Weights are small and belong to the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.functions import vectors as V
from hopweave.functions.portable import weights

from .aggregation import aggregate_neighbors, gcn, pairwise_mean, self_gather, split_sum, sum_gradient


def linear(h: DataFrame, w: list[list[float]], b: list[float] | None = None) -> DataFrame:
    return h.select("node", V.linear(F.col("vec"), w, b).alias("vec"))


def activate(h: DataFrame, activation=V.relu) -> DataFrame:
    return h.select("node", activation(F.col("vec")).alias("vec"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v of the product of sparse matrices (i, k, v) and (k, j, v)."""
    x, y = a.select("i", "k", F.col("v").alias("_a")), b.select("k", "j", F.col("v").alias("_b"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("node", F.col("vec").alias("_b")), "node").select("node", F.concat("vec", "_b").alias("vec"))


def softmax(logits: DataFrame, classes: int) -> DataFrame:
    top = F.greatest(*V.parts(F.col("vec"), classes))
    rows = logits.withColumn("_e", F.transform("vec", lambda x: F.exp(x - top)))
    total = sum((F.col("_e")[i] for i in range(1, classes)), F.col("_e")[0])
    return rows.withColumn("prob", F.transform("_e", lambda x: x / total)).drop("_e")


def cross_entropy(logits: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """node, label, loss."""
    top = F.greatest(*V.parts(F.col("vec"), classes))
    total = sum((F.exp(F.col("vec")[i] - top) for i in range(1, classes)), F.exp(F.col("vec")[0] - top))
    return logits.join(labels.select("node", "label"), "node").select("node", "label", (top + F.log(total) - F.col("vec")[F.col("label")]).alias("loss"))


def cross_entropy_gradient(logits: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """node, vec = (softmax - onehot) / N."""
    n = logits.agg(F.count("*").alias("_n"))
    rows = softmax(logits, classes).join(labels.select("node", "label"), "node").crossJoin(F.broadcast(n))
    return rows.select("node", F.transform("prob", lambda p, k: (p - F.when(k == F.col("label"), 1.0).otherwise(0.0)) / F.col("_n")).alias("vec"))


def weight_gradient(x: DataFrame, grad: DataFrame, rows: int, columns: int) -> DataFrame:
    """i, k, value of X^T G, summed as rows * columns scalar columns."""
    both = x.join(grad.select("node", F.col("vec").alias("_g")), "node")
    sums = both.agg(*[F.sum(F.col("vec")[i] * F.col("_g")[k]).alias(f"g{i}_{k}") for i in range(rows) for k in range(columns)])
    cells = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(k).cast("bigint").alias("k"), F.col(f"g{i}_{k}").alias("value")) for i in range(rows) for k in range(columns)])
    return sums.select(F.explode(cells).alias("c")).select("c.i", "c.k", "c.value")


def linear_backward(grad: DataFrame, w: list[list[float]]) -> DataFrame:
    """Gradient of a linear layer's input: G W^T."""
    return linear(grad, [list(col) for col in zip(*w)])


def relu_backward(out: DataFrame, grad: DataFrame) -> DataFrame:
    return grad.join(out.select("node", F.col("vec").alias("_o")), "node").select("node", F.zip_with("vec", "_o", lambda g, o: F.when(o <= 0, 0.0).otherwise(g)).alias("vec"))


def sgd_step(gradient: DataFrame, w: list[list[float]], rate: float) -> DataFrame:
    """i, k, value of W - rate * dW."""
    current = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, map(float, r))) for r in w]), (F.col("i") + 1).cast("int")), (F.col("k") + 1).cast("int"))
    return gradient.select("i", "k", (current - F.lit(float(rate)) * F.col("value")).alias("value"))


def adam(x: DataFrame, labels: DataFrame, w: list[list[float]], classes: int, steps: int, rate: float = 0.05) -> list[list[float]]:
    """Weights after steps of Adam: gradients are summed by Spark, the small state is kept here."""
    import numpy as np

    now = np.array(w, float)
    m, v = np.zeros_like(now), np.zeros_like(now)
    for t in range(1, steps + 1):
        g = np.zeros_like(now)
        for i, k, value in weight_gradient(x, cross_entropy_gradient(linear(x, now.tolist()), labels, classes), len(w), classes).collect():
            g[i, k] = value
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        now -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return now.tolist()


def correct(logits: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """node, correct: no other class scores strictly more than the label's."""
    rows = logits.join(labels.select("node", "label"), "node")
    return rows.select("node", (F.greatest(*V.parts(F.col("vec"), classes)) <= F.col("vec")[F.col("label")]).alias("correct"))


def accuracy(logits: DataFrame, labels: DataFrame, classes: int, split: DataFrame | None = None) -> DataFrame:
    rows = correct(logits, labels, classes)
    measures = [F.count("*").alias("n"), F.sum(F.col("correct").cast("bigint")).alias("n_correct"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")]
    return rows.join(split, "node").groupBy("split").agg(*measures) if split is not None else rows.agg(*measures)


def losses(loss: DataFrame, owners: DataFrame) -> DataFrame:
    """The mean loss, and the sum over owners of their nodes' mean losses, which is another number."""
    per = loss.join(owners, "node").groupBy("part").agg(F.avg("loss").alias("m"), F.sum("loss").alias("s"), F.count("*").alias("n"))
    return per.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean_loss"), F.round(F.sum("m"), 6).alias("owner_mean_sum"))


# --- models


def mlp(x: DataFrame, sizes: list[int]) -> DataFrame:
    for a, b in zip(sizes, sizes[1:]):
        x = linear(x, weights(a, b))
        x = activate(x) if b != sizes[-1] else x
    return x


def gcn_sum(block: DataFrame, x: DataFrame, sizes: list[int], keep=None) -> DataFrame:
    """A linear layer over neighbour sums, twice, with relu between. A layer that makes vectors shorter runs before the sum, which
    it commutes with, so the shorter ones are shuffled."""
    for layer, (a, b) in enumerate(zip(sizes, sizes[1:])):
        x = aggregate_neighbors(block, linear(x, weights(a, b)), b) if b < a else linear(aggregate_neighbors(block, x, a), weights(a, b))
        x = activate(x) if layer < len(sizes) - 2 else x
        x = keep(x) if keep and layer < len(sizes) - 2 else x
    return x


def sage_layer(block: DataFrame, h: DataFrame, dims: int, out: int, neighbours) -> DataFrame:
    """concat(own, neighbours) W. Where W makes vectors shorter its two halves run first, one on the nodes' own rows and one on
    what neighbours send: every way to merge neighbours is linear."""
    w = weights(2 * dims, out)
    if out >= dims:
        return linear(concat(self_gather(block, h, dims), neighbours(block, h, dims)), w)
    own, far = self_gather(block, linear(h, w[:dims]), out), neighbours(block, linear(h, w[dims:]), out)
    return own.join(far.select("node", F.col("vec").alias("_b")), "node").select("node", V.plus(F.col("vec"), F.col("_b")).alias("vec"))


def sage(blocks: list[DataFrame], x: DataFrame, sizes: list[int], merge: str = "mean", owners: DataFrame | None = None, keep=None) -> DataFrame:
    """SAGE over blocks given from the deepest hop to the seeds'. merge: mean, sum (over split partials), pairwise or gcn.

    pairwise and sum take blocks with `part` (see splitting.split_blocks).
    """
    ways = {
        "mean": lambda b, h, d: aggregate_neighbors(b, h, d, reduce="mean"),
        "sum": split_sum,
        "pairwise": lambda b, h, d: pairwise_mean(b, h, owners, d),
        "gcn": gcn,
    }
    if merge not in ways:
        raise ValueError(f"unknown model: {merge}")
    for layer, (block, a, b) in enumerate(zip(blocks, sizes, sizes[1:])):
        x = sage_layer(block, x, a, b, ways[merge])
        x = activate(x) if layer < len(blocks) - 1 else x
        x = keep(x) if keep and layer < len(blocks) - 1 else x
    return x


def full_inference(edges: DataFrame, nodes: DataFrame, x: DataFrame, sizes: list[int], keep=None) -> DataFrame:
    """Every layer over all nodes and edges; a self edge each."""
    block = edges.select("src", "dst").unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    return sage([block] * (len(sizes) - 1), x, sizes, keep=keep)


def bias_gradient(grad: DataFrame, columns: int) -> DataFrame:
    """k, value: the sum of the gradient over all rows."""
    sums = grad.agg(*[F.coalesce(F.sum(F.col("vec")[k]), F.lit(0.0)).alias(f"g{k}") for k in range(columns)])
    return sums.select(F.posexplode(F.array(*[F.col(f"g{k}") for k in range(columns)])).alias("k", "value")).select(F.col("k").cast("bigint").alias("k"), "value")


def two_layer_step(x: DataFrame, labels: DataFrame, sizes: tuple[int, int, int], rate: float, block: DataFrame | None = None, keep=None) -> DataFrame:
    """param (w1, b1, w2, b2), i, k, value after one step of gradient descent of relu(x W1 + b1) W2 + b2 under cross entropy.

    With a block (src, dst) each layer takes sums over in-neighbours too (a graph convolution), and gradients go back along
    reversed edges. Sums are taken of the shorter of a layer's input and output, as the layer commutes with them: (A x) W = A (x W)
    forward and (A x)' g = x' (A' g) backward. keep writes what the forward pass leaves for the backward one.
    """
    keep = keep or (lambda df: df)
    a, b, c = sizes
    w1, b1, w2, b2 = weights(a, b), weights(1, b)[0], weights(b, c), weights(1, c)[0]
    early = block is not None and b < a
    s1 = x if block is None or early else keep(aggregate_neighbors(block, x, a))
    z1 = V.plus(F.col("vec"), F.array(*map(F.lit, map(float, b1)))).alias("vec")
    h = keep(activate(aggregate_neighbors(block, linear(x, w1), b).select("node", z1) if early else linear(s1, w1, b1)))
    s2 = keep(aggregate_neighbors(block, h, b)) if block is not None else h
    g2 = keep(cross_entropy_gradient(linear(s2, w2, b2), labels, c).select("node", "vec"))
    back = linear_backward(g2, w2)
    back = sum_gradient(block, back, b) if block is not None else back
    g1 = keep(relu_backward(h, back))
    sent = keep(sum_gradient(block, g1, b)) if early else g1
    out = None
    for name, rows, w in (("w1", weight_gradient(s1, sent, a, b), w1), ("w2", weight_gradient(s2, g2, b, c), w2), ("b1", bias_gradient(g1, b).withColumn("i", F.lit(0).cast("bigint")), [b1]), ("b2", bias_gradient(g2, c).withColumn("i", F.lit(0).cast("bigint")), [b2])):
        step = sgd_step(rows.select("i", "k", "value"), w, rate).select(F.lit(name).alias("param"), "i", "k", "value")
        out = step if out is None else out.unionByName(step)
    return out
