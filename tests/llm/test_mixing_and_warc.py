"""Mixing: targets, epochs, reruns. WARC: byte ranges, records, revisits. Whole queries are tested against SQL in test_sql.py."""

import hashlib
import re
import zlib

import pytest
from cases import edge_docs, edge_rows, no_docs

from hopweave.llm import mixing, warc
from hopweave.llm.common import Committed, new_path

PAGES = "page_id long, url string, html string"


def brute_targets(sizes, share=1.5, most=2.0):
    """Caps and resharing, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    out, rest, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        rest -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10, None: 5}, {"a": 7}, {"a": 0, "b": 50}, {"é": 10, "z": 10, "Z": 500, "a": 20, None: 900}, {"a": 0}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame, 1.5, 2.0).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_taken_comes_near_the_target_and_reruns_agree(spark, sf):
    got = mixing.op8_mixing(spark, sf).orderBy("doc_id").collect()
    assert got == mixing.op8_mixing(spark, sf).orderBy("doc_id").collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_complete_epochs_come_first(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5), "x" if i < 5 else "y") for i in range(400)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in mixing.mix_documents(docs, labels).collect():
        assert r["epochs"] == int(r["target"] / r["source_size"] + 1e-9) and r["taken"] == (r["epochs"] + r["selected"]) * r["size"]


def test_good_documents_are_taken_more_often(spark):
    docs = spark.createDataFrame([(i, f"a b c d {i}", s) for i in range(3000) for s in ("x",)] + [(i, "a b", "y") for i in range(3000, 3100)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    rows = [r for r in mixing.mix_documents(docs, labels).collect() if r["source"] == "x"]
    assert rows[0]["epochs"] == 1
    good, bad = (sum(r["selected"] for r in rows if r["weight"] == w) for w in (2.0, 0.5))
    assert good > 1.2 * bad


def test_mixing_edge_rows(spark):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix_documents(edge_docs(spark, wide=True), labels).collect()
    assert sorted(r["size"] for r in got) == sorted(len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in edge_rows())
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_documents(no_docs(spark), labels).count() == 0


def pages():
    big = "<p>" + "x" * 2000 + "</p>"
    return [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9 b\nc", big), (3, None, None), (4, "http://a/4", ""), (5, "u", "small"), (6, "u", "small"), (None, "n", big), (None, "n", "y" * 1000), (7, "é", "ü" * 600), (8, "é", "ü" * 600), (8, "é", "ü" * 600), (10, "r\r\n\r\n", "\r\n\r\n" + "z" * 5000)]


def test_archives_round_trip(spark):
    rows = pages()
    index = warc.write_warc(spark.createDataFrame([(*r, "extra") for r in rows], PAGES + ", file string"), new_path(spark, "warc"))
    got = warc.read_warc(index).collect()
    payloads = sorted((r[2] or "").encode() for r in rows)
    assert sorted((r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((len(p), hashlib.sha1(p).hexdigest()) for p in payloads)
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1) for r in got)
    assert kinds == sorted([(1, "revisit", 9), (2, "revisit", 9), (9, "response", -1), (3, "response", -1), (4, "response", -1), (5, "response", -1), (6, "response", -1), (-1, "revisit", 9), (-1, "response", -1), (7, "revisit", 8), (8, "response", -1), (8, "response", -1), (10, "response", -1)])
    html = {r[0]: r[2] or "" for r in rows}
    assert all(r["html"] == html[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"])


def test_members_are_gzip_at_their_offsets_and_selection_reads_only_them(spark):
    index = warc.write_warc(spark.createDataFrame(pages(), PAGES), new_path(spark, "warc"))
    for r in index.collect():
        with open(re.sub("^file:(//)?", "", r["file"]), "rb") as f:
            f.seek(r["offset"])
            record = warc.parse(zlib.decompress(f.read(r["length"]), wbits=31))
        assert record["headers"]["warc-type"] == r["record_type"]
        assert int(record["headers"]["content-length"]) == len(record["http"]) + 4 + len(record["payload"])
    got = warc.read_warc(index.where("page_id in (9, 10)")).collect()
    assert sorted(r["page_id"] for r in got) == [9, 10]


def test_ranges_are_coalesced():
    assert list(warc.ranges([0, 10, 100, 1000], [10, 20, 5, 1], gap=70, most=200)) == [(0, 3, 0, 105), (3, 4, 1000, 1)]
    assert list(warc.ranges([0, 10, 20], [10, 10, 10], gap=0, most=20)) == [(0, 2, 0, 20), (2, 3, 20, 10)]
    assert list(warc.ranges([], [], 1, 1)) == []


def test_no_pages(spark):
    index = warc.write_warc(spark.createDataFrame([], PAGES), new_path(spark, "warc"))
    assert index.count() == 0 and warc.read_warc(index).count() == 0


def test_record_ids_differ_and_revisits_refer_to_a_response(spark):
    rows = [*pages(), (None, "u", "small"), (None, "u", "small"), (3, "u", "again")]
    heads = []
    for r in warc.write_warc(spark.createDataFrame(rows, PAGES), new_path(spark, "warc")).collect():
        with open(re.sub("^file:(//)?", "", r["file"]), "rb") as f:
            f.seek(r["offset"])
            heads.append(warc.parse(zlib.decompress(f.read(r["length"]), wbits=31))["headers"])
    ids = [h["warc-record-id"] for h in heads]
    assert len(heads) == len(rows) and len(set(ids)) == len(ids) - 1  # page 8 is twice the response that page 7 refers to
    responses = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 4
    for h in revisits:
        assert responses[h["warc-refers-to"]]["x-page"] == h["x-refers-to-page"]
        assert responses[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"]


def test_a_failed_archive_leaves_no_file(spark, tmp_path):
    path = f"{tmp_path}/a.warc.gz"
    with pytest.raises(RuntimeError), Committed(f"file://{path}") as f:
        f.write(b"x")
        raise RuntimeError
    assert list(tmp_path.iterdir()) == []


def test_one_payload_in_most_pages_by_shuffle(spark):
    """Beyond the broadcast bound a payload of 90 % of the pages, and equal small ones, still lie in many archives."""
    big = "<p>" + "w" * 1500 + "</p>"
    rows = [(i, f"u{i}", big if i % 10 else ("" if i % 20 else f"{i // 40:04d}" * 400)) for i in range(2000)]
    table = spark.createDataFrame(rows, PAGES)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = warc.write_warc(table, new_path(spark, "warc"), broadcast_rows=1)
        most = index.groupBy("file").count().agg({"count": "max"}).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 700, most
    plain = warc.write_warc(table, new_path(spark, "warc"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    a, b = (sorted(map(str, warc.read_warc(i).select(*columns).collect())) for i in (index, plain))
    assert a == b and sum("revisit" in x for x in a) == 1799 + 50  # the large payload's, and every second of the pairs


def test_each_attempt_has_its_own_archive(spark):
    index = warc.write_warc(spark.createDataFrame(pages(), PAGES).repartition(3), new_path(spark, "warc"))
    names = {r["file"].rpartition("/")[2] for r in index.collect()}
    assert all(re.fullmatch(r"archive-\d{6}-\d+\.warc\.gz", n) for n in names)
