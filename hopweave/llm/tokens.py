"""Token-id files: a concatenated id array with Elias-Fano encoded document ends.

A shard is one range of the order (doc_id, null first; equal ids by text). It is written in pieces of about `shard_bytes` of ids, so
a task holds one piece and never its whole range, however few shards there are. A piece is a file of its documents, as

    header   8 x uint64: magic, documents, ids, id width in bytes, nulls among doc_ids, low bits l, words of the upper part, samples
    doc_ids  int64 each, nulls first
    low      l low bits of each document's end offset, packed
    upper    unary upper parts, uint64 words (little endian)
    select   position of every 256th one of the upper part, uint64
    ids      uint16 or uint32, little endian

The ends take 2 + log2(ids / documents) bits a document, and `EliasFano.get` finds any of them from one sample and a short scan.

Cases: null text is empty and yields the end id alone; a null doc_id sorts first; equal doc_ids follow each other in text order;
an empty table yields no shard; a very long text is encoded whole and may be a piece by itself; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Committed, load, new_path, read_range, small_batches, store, tidy, written

MAGIC = 0x31464554574F5048
HEADER = 64
EVERY = 256
SHARD_BYTES = 64 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2^63."""

    def __init__(self, n: int, bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.upper, self.samples = n, bits, low, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        top = int(values[-1])
        bits = max(0, (max(top, 1) // n).bit_length() - 1)
        if bits:
            rows = (values[:, None] >> np.arange(bits)) & 1
            low = np.packbits(rows.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (values >> bits) + np.arange(n)
        flags = np.zeros((int(ones[-1]) // 64 + 1) * 64, np.uint8)
        flags[ones] = 1
        upper = np.packbits(flags, bitorder="little").view("<u8")
        return cls(n, bits, low, upper, ones[::EVERY].astype(np.uint64))

    def get(self, i: int) -> int:
        """Value i, by select on the upper bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // EVERY])
        left, word = i % EVERY, at // 64
        bits = int(self.upper[word]) >> (at % 64) << (at % 64)
        while (k := bits.bit_count()) <= left:
            left -= k
            word += 1
            bits = int(self.upper[word])
        for _ in range(left):
            bits &= bits - 1
        one = word * 64 + (bits & -bits).bit_length() - 1
        low = 0
        for j in range(self.bits):
            p = i * self.bits + j
            low |= (int(self.low[p >> 3]) >> (p & 7) & 1) << j
        return (one - i) << self.bits | low

    def decode(self) -> np.ndarray:
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))
        high = ones.astype(np.int64) - np.arange(self.n)
        if not self.bits:
            return high
        rows = np.unpackbits(self.low, count=self.n * self.bits, bitorder="little").reshape(self.n, self.bits)
        return high << self.bits | rows.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))


class Pieces(dict):
    """Ids of pieces, in two generations: what is missing is taken from the one before, else made. What recurs stays; the rest goes in time."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.make(piece)
        self[piece] = ids
        return ids

    def age(self) -> None:
        """A full generation becomes the one before."""
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Token ids of whole texts, by the tokenizers library.

    The byte-level pre-tokenizer joins nothing across these places, so texts are cut there, the ids of recurring pieces are kept,
    and the ids are those of the uncut text: before a single space and around a single line feed that stand between characters
    that are no white space, and between letters and the full stops or commas that end such a piece. For a tokenizer of another kind
    the library gets whole texts.
    """

    TIGHT = re.compile(r"\s\s|\x00")
    RARE = ["  ", "\n\n", " \n", "\n ", "\x00", *(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n")]  # a text without these has nothing tight
    PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]+)?")

    def __init__(self, path: str, keep: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Pieces(self.make, keep)
        self.model = self.tokenizer.model.tokenize
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that the byte-level alphabet leaves as they are; the others follow from 256
        self.alphabet = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.cuts = self.may_cut()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def may_cut(self) -> bool:
        """Whether the tokenizer is byte-level without a normalizer, a space of its own or chance, and no token of its own is found across cuts."""
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        t = self.tokenizer
        if t.normalizer is not None or not isinstance(t.pre_tokenizer, ByteLevel) or not isinstance(t.model, BPE):
            return False
        if t.pre_tokenizer.add_prefix_space or not t.pre_tokenizer.use_regex or t.model.dropout:
            return False
        own = t.get_added_tokens_decoder().values()
        return not any(a.lstrip or a.rstrip or a.single_word or re.search(r"\s|\x00", a.content) or self.PLAIN.fullmatch("a" + a.content) for a in own)

    @classmethod
    def cut(cls, text: str) -> list[str]:
        rare = any(c in text for c in cls.RARE)
        if not rare or not cls.TIGHT.search(text):
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        parts = text.split(" ")
        out = [parts[0]]
        for before, part in zip(parts, parts[1:]):
            if part and before and not part[0].isspace() and not before[-1].isspace():
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return out

    def make(self, piece: str) -> bytes:
        """The ids of a piece.

        A word, a run of marks, and a word with a run of marks after it are one or two of the pre-tokenizer's own pieces: their ids come
        straight from the library's model, in the byte-level alphabet. Everything else goes through the whole tokenizer.
        """
        found = self.PLAIN.fullmatch(piece)
        if not found:
            return np.array(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, self.dtype).tobytes()
        word, marks = found.groups()
        if not marks:
            return self.model_ids(word)
        known = self.known
        return (known.get(word) or known.before.get(word) or self.model_ids(word)) + known[marks]

    def model_ids(self, part: str) -> bytes:
        letters = part.replace(" ", "\u0120") if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        return array(self.dtype.char, [t.id for t in self.model(letters)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        self.known.age()
        get = self.known.__getitem__
        return [b"".join(map(get, self.cut(t))) if t else b"" for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _groups(columns: list[pa.Array], most: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about `most` characters each."""
    ids, texts, size = [], [], 0
    for i, t in zip(*columns):
        i, t = i.as_py(), t.as_py()
        ids.append(i)
        texts.append(t)
        size += len(t or "")
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_piece(path: str, kind: np.dtype, doc_ids: list[int | None], lengths: list[int], parts: list[bytes]) -> tuple[int, int]:
    """Writes the documents with these ids, numbers of token ids and bytes; returns the numbers of documents and token ids."""
    ends = np.cumsum(np.array(lengths, np.int64))
    ef = EliasFano.encode(ends)
    nulls = sum(i is None for i in doc_ids)
    head = np.array([MAGIC, ef.n, ends[-1], kind.itemsize, nulls, ef.bits, len(ef.upper), len(ef.samples)], "<u8")
    with Committed(path) as f:
        for x in (head, np.array([i or 0 for i in doc_ids], "<i8"), ef.low, ef.upper, ef.samples):
            f.write(x.tobytes())
        for a in range(0, len(parts), 4096):
            f.write(b"".join(parts[a : a + 4096]))
    return ef.n, int(ends[-1])


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, shards: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards of about equal row counts in ascending doc_id order and returns their manifest: shard, piece, path, n_docs, n_ids."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, k, piece = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.dtype).tobytes()
        doc_ids, lengths, parts, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, parts, size, piece
            path = f"{out}/shard-{k:06d}-{piece:06d}.tok"
            n_docs, n_ids = write_piece(path, coder.dtype, doc_ids, lengths, parts)
            row = pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "piece": pa.array([piece], pa.int32()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})
            doc_ids, lengths, parts, size, piece = [], [], [], 0, piece + 1
            return row

        for batch in batches:
            for ids, texts in _groups(batch.columns[:2], min(1_000_000, shard_bytes)):
                doc_ids += ids
                for b in coder.encode(texts):
                    parts.append(b)
                    parts.append(end)
                    lengths.append(len(b) // coder.dtype.itemsize + 1)
                    size += len(b) + len(end)
                if size >= shard_bytes:
                    yield close()
        if doc_ids:
            yield close()

    rows = small_batches(docs).select("doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(tidy(shard), "shard int, piece int, path string, n_docs long, n_ids long"), "tokens-manifest")


def open_shard(path: str) -> tuple[np.ndarray, int, EliasFano, int, np.dtype]:
    """doc_ids, nulls among them, ends, where the ids begin, and their type."""
    head = np.frombuffer(read_range(path, 0, HEADER), "<u8").astype(np.int64)
    if int(head[0]) != MAGIC:
        raise ValueError(f"{path} is no token shard")
    _, n, _, width, nulls, bits, words, samples = (int(x) for x in head)
    low = (n * bits + 7) // 8
    body = read_range(path, HEADER, 8 * n + low + 8 * words + 8 * samples)
    ids = np.frombuffer(body, "<i8", n)
    ef = EliasFano(n, bits, np.frombuffer(body, np.uint8, low, 8 * n), np.frombuffer(body, "<u8", words, 8 * n + low), np.frombuffer(body, "<u8", samples, 8 * n + low + 8 * words))
    return ids, nulls, ef, HEADER + len(body), np.dtype(f"<u{width}")


def read_document(path: str, i: int) -> np.ndarray:
    """Ids of document i of a shard, by two selects and one ranged read."""
    _, _, ef, at, kind = open_shard(path)
    a, b = (ef.get(i - 1) if i else 0), ef.get(i)
    return np.frombuffer(read_range(path, at + a * kind.itemsize, (b - a) * kind.itemsize), kind)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, piece, position: what the files hold. start counts the ids of all documents before."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, piece, path, base in zip(frame["shard"], frame["piece"], frame["path"], frame["base"]):
                ids, nulls, ef, at, kind = open_shard(path)
                ends = ef.decode()
                starts = np.concatenate([[0], ends[:-1]])
                crcs = np.zeros(len(ends), np.int64)
                fs, name = store(path)
                with fs.open_input_file(name) as f:
                    f.seek(at)
                    for i, n in enumerate(ends - starts):
                        crcs[i] = zlib.crc32(np.frombuffer(f.read(int(n) * kind.itemsize), kind).astype("<u4").tobytes())
                doc_ids = pd.array(ids, "Int64")
                doc_ids[:nulls] = pd.NA
                yield pd.DataFrame({"doc_id": doc_ids, "start": base + starts, "n_tokens": ends - starts, "ids_crc32": crcs, "shard": shard, "piece": piece, "position": np.arange(len(ends))})

    before = Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = manifest.select("shard", "piece", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return based.repartition(parts, "shard", "piece").mapInPandas(tidy(scan), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, piece int, position long")


def token_output(docs: DataFrame, out: str | None = None, tokenizer_path: str | None = None, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text), writes the shards under out (default: a new folder in the shared one) and reads them back."""
    import public_tokenizers

    spark = docs.sparkSession
    shards = shards or 2 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_tokens(write_tokens(docs, out or new_path(spark, "tokens"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), end_id, shards))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(load(spark, sf_dir, "documents"))
