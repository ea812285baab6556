"""Balanced partitioning: falling cuts, its bound, its fixed point, and what it finds."""

import random
from collections import Counter, defaultdict

from hopweave.operators import owners as O
from hopweave.sources.kept import kept


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def owners_of(spark, parts):
    return spark.createDataFrame(list(parts.items()), "node bigint, part int")


def cut(pairs, part):
    return sum(part[a] != part[b] for a, b in pairs if a != b)


def communities(seed=1, groups=4, size=30, inside=240, across=60):
    r = random.Random(seed)
    pairs = [(g * size + r.randrange(size), g * size + r.randrange(size)) for g in range(groups) for _ in range(inside)]
    return pairs + [(r.randrange(groups * size), r.randrange(groups * size)) for _ in range(across)]


def test_converges_below_one_pass(spark):
    pairs, n = communities(), 120
    r = random.Random(2)
    start = {i: r.randrange(4) for i in range(n)}
    edges, owners = edges_of(spark, pairs), owners_of(spark, start)
    once = {x.node: x.part for x in O.label_propagation(edges, owners).collect()}
    found, cuts = O.balanced_partition(edges, owners, keep=kept)
    part = {x.node: x.part for x in found.collect()}
    assert set(part) == set(start) and max(Counter(part.values()).values()) <= int(n * 1.1 / 4)
    assert all(a > b for a, b in zip(cuts, cuts[1:])), cuts
    assert cuts[0] == cut(pairs, start) and cuts[-1] == cut(pairs, part) < cut(pairs, once)
    # a fixed point: whoever would gain by a move has no room there
    near, held = defaultdict(Counter), Counter(part.values())
    for a, b in pairs:
        if a != b:
            near[a][part[b]] += 1
            near[b][part[a]] += 1
    for i, c in near.items():
        for p, k in c.items():
            assert p == part[i] or k <= c[part[i]] or held[p] >= int(n * 1.1 / 4)
    again, more = O.balanced_partition(edges, found, keep=kept)
    assert more == [cuts[-1]] and {x.node: x.part for x in again.collect()} == part


def test_rounds_and_empty_graphs(spark):
    owners = owners_of(spark, {i: i % 4 for i in range(8)})
    found, cuts = O.balanced_partition(edges_of(spark, []), owners)
    assert cuts == [0] and found.count() == 8
    loops, cuts = O.balanced_partition(edges_of(spark, [(1, 1), (1, 1)]), owners)
    assert cuts == [0]
    pairs = communities(3)
    _, cuts = O.balanced_partition(edges_of(spark, pairs), owners_of(spark, {i: i % 4 for i in range(120)}), most_rounds=2, keep=kept)
    assert len(cuts) == 2
