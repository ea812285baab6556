"""The partitioner's files in chunks against their small form, byte for byte."""

import numpy as np
import pytest

from hopweave.operators import owners as O
from hopweave.plans import queries
from hopweave.sources import graphs as G
from hopweave.sources import partitioner as W


def plain(pairs, n):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    top = max(len(v) for v in near.values())
    lines = [f"{n} {sum(map(len, near.values())) // 2} 100"]
    return "".join(x + "\n" for x in lines + [" ".join([str(10 * len(near[i]) // top), *(str(j + 1) for j in sorted(near[i]))]) for i in range(n)])


def joined(path):
    return "".join(p.read_text() for p in sorted(path.iterdir()) if p.name[0] not in "._")


@pytest.mark.parametrize("chunk,run,file_bytes", [(4096, 1 << 16, 64 << 20), (3, 4, 50), (1, 1, 7)])
def test_bytes_equal_the_small_form(spark, tmp_path, chunk, run, file_bytes):
    """A hub with all other nodes, an isolated node, a loop and a repeated edge."""
    pairs = [(0, i) for i in range(1, 40) if i != 17] + [(3, 4), (4, 3), (5, 5), (6, 9), (6, 9)]
    edges, nodes = spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.range(40).withColumnRenamed("id", "node")
    chunks = W.line_chunks(edges, nodes, chunk, run)
    assert max(len(r.text.split()) for r in chunks.where("node >= 0").collect()) <= chunk + 1
    W.write_lines(chunks, f"{tmp_path}/a", file_bytes)
    assert joined(tmp_path / "a") == plain(pairs, 40)
    W.write_lines(chunks, f"{tmp_path}/a", file_bytes)  # again: the same files
    assert joined(tmp_path / "a") == plain(pairs, 40)


def test_whole_graph_and_its_rows(spark, sf, tmp_path):
    g = queries.load(spark, sf)
    G.write_metis(g.edges, g.nodes, f"{tmp_path}/small")
    W.write_lines(W.line_chunks(g.edges, g.nodes, 2, 100), f"{tmp_path}/chunks", 1000)
    assert joined(tmp_path / "chunks") == joined(tmp_path / "small")


def test_owner_maps(spark, tmp_path):
    owners = O.modulo(spark.range(100).withColumnRenamed("id", "node"), 13)
    W.write_owner_map(owners, f"{tmp_path}/map.bin")
    (file,) = [p for p in (tmp_path / "map.bin").iterdir()]
    assert np.fromfile(file, "<i4").tolist() == [i % 13 for i in range(100)]
    W.write_owner_lines(owners, f"{tmp_path}/lines", chunk=7, file_bytes=40)
    assert joined(tmp_path / "lines") == "".join(f"{i % 13}\n" for i in range(100))
    assert sorted((r.node, r.part) for r in G.read_parts(spark, _one_file(tmp_path)).collect()) == [(i, i % 13) for i in range(100)]


def _one_file(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "parts.txt").write_text(joined(tmp_path / "lines"))
    return str(tmp_path / "one")
