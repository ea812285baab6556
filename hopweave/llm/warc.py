"""WARC archives written and read by an index of byte ranges.

Writing: each task writes one archive of gzip members, one member a record, and returns an index row for each: file, offset,
length, url, digest. Reading: the selected index rows are dealt out by file, sorted by offset, and neighbouring ranges are read
in one request; only the selected members are decompressed.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is a response and the others are
revisits of it (a null page_id is the smallest; rows that tie for the largest are all responses).

Cases: null html is an empty payload; null url is written as an empty target; null page_id stays null; rows that repeat are
records of their own, with ids of their own but for repeated responses that revisits refer to; an empty table writes no archive;
a very long html is one record, held whole by its task; other columns of the pages are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Committed, load, new_path, small_batches, store, written

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("7b0d3c5e-0f4a-4a57-9d0e-5f0b2d5e8a11")


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """The id of a record that others refer to, from what they know of it; of any other record, with its place in the archives."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {digest} {place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """One uncompressed record; a revisit keeps the HTTP head, with the full payload's length, and leaves the payload out.

    place, archive and offset, keeps the ids of records apart whose pages have one id or none.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, '' if refers_to is not None and not revisit else place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-case names) and http head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": http, "payload": payload}


def revisit_of(pages: DataFrame, digest: Column, size: Column, least: int, broadcast_rows: int = 500_000, hot_pages: int = 1_000) -> DataFrame:
    """pages with payload_digest and _first, the response's page_id (null where the payload is too small or stands alone).

    Up to broadcast_rows repeated digests (about 100 bytes each) are broadcast, and pages stay where they are. Beyond that only
    those of over hot_pages pages are (pages / hot_pages at most, and hot_pages grows so that they stay within the bound); the
    others' pages are dealt by digest, and pages that need no digest of their own by a hash of their place.
    """
    rows = pages.withColumn("payload_digest", digest)
    shared = rows.where(size >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    shared = written(shared.select(F.col("payload_digest").alias("_digest"), "_first", "_n"), "warc-shared")
    found, repeats = shared.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    known = (F.col("payload_digest") == F.col("_digest")) & (size >= least)
    if found <= broadcast_rows:
        return rows.join(F.broadcast(shared.drop("_n")), known, "left").drop("_digest")
    hot = F.col("_n") > max(hot_pages, repeats // max(1, broadcast_rows))
    rows = rows.join(F.broadcast(shared.where(hot).select("_digest", F.col("_first").alias("_hot_first"))), known, "left").drop("_digest")
    place = F.concat(F.lit("-"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
    rows = rows.withColumn("_key", F.when((size >= least) & F.col("_hot_first").isNull(), F.col("payload_digest")).otherwise(place))
    few = shared.where(~hot).select(F.col("_digest").alias("_key"), "_first")
    rows = rows.join(few, "_key", "left")
    return rows.select(*pages.columns, "payload_digest", F.coalesce("_hot_first", "_first").alias("_first"))


def write_warc(pages: DataFrame, out: str, least: int = 1000, level: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """Writes pages (page_id, url, html) under out and returns the index, itself a Parquet table beside the archives. Archives of
    attempts that did not win stay behind without an index row."""
    html = F.coalesce("html", F.lit(""))
    dealt = revisit_of(small_batches(pages).select("page_id", "url", html.alias("html")), F.sha1(F.encode(html, "UTF-8")), F.octet_length(html), least, broadcast_rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each attempt has a file of its own: another attempt's rows may come in another order, and its index is not this one's
        name = f"{out}/archive-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        at, file = 0, None
        with ExitStack() as open_files:  # a failed task leaves no file behind
            for batch in batches:
                rows: dict[str, list] = {k: [] for k in ("page_id", "url", "file", "offset", "length", "payload_digest", "record_type")}
                for page_id, url, html, digest, first in zip(*batch.columns):
                    page_id, url, payload, digest, first = page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), first.as_py()
                    revisit = first is not None and first != page_id
                    z = zlib.compressobj(level, wbits=31)
                    member = z.compress(record(page_id, url, payload, digest, first, revisit, f"{name.rpartition('/')[2]} {at}")) + z.flush()
                    if file is None:
                        file = open_files.enter_context(Committed(name))
                    file.write(member)
                    for k, v in zip(rows, (page_id, url, name, at, len(member), digest, "revisit" if revisit else "response")):
                        rows[k].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())]))

    rows = dealt.select("page_id", "url", "html", "payload_digest", "_first")
    return written(rows.mapInArrow(write, INDEX), "warc-index")


def ranges(offsets: list[int], lengths: list[int], gap: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, end, offset, length): runs of sorted byte ranges to read at once."""
    a = 0
    for b in range(1, len(offsets) + 1):
        if b == len(offsets) or offsets[b] - (offsets[b - 1] + lengths[b - 1]) > gap or offsets[b] + lengths[b] - offsets[a] > most:
            yield a, b, offsets[a], offsets[b - 1] + lengths[b - 1] - offsets[a]
            a = b


def read_warc(index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """The records that the index rows select: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, own in frame.groupby("file", sort=False):
                fs, path = store(file)
                offsets, lengths = own["offset"].tolist(), own["length"].tolist()
                with fs.open_input_file(path) as f:
                    for a, b, offset, length in ranges(offsets, lengths, gap, most):
                        f.seek(offset)
                        data, out = f.read(length), []
                        for i in range(a, b):
                            r = parse(zlib.decompress(data[offsets[i] - offset : offsets[i] - offset + lengths[i]], wbits=31))
                            h, revisit = r["headers"], r["headers"]["warc-type"] == "revisit"
                            size = int(re.search(rb"Content-Length: (\d+)", r["http"])[1])
                            digest = h["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(r["payload"]).hexdigest()
                            out.append((int(h["x-page"]) if "x-page" in h else None, h["warc-target-uri"], size, digest, h["warc-type"], int(h["x-refers-to-page"]) if revisit else None, None if revisit else r["payload"].decode()))
                        frame_out = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
                        yield frame_out.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a file's index is cut into stretches of 64 MB of archive, so that one large file is many tasks' work
    dealt = index.select("file", "offset", "length").repartition(parts, "file", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(load(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.n > 1 AND g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.n > 1 AND g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
"""
