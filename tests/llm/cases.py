"""Rows that every operator must take: nulls in any column, empty and very long texts, repeats, ties, and columns with other meanings."""

from __future__ import annotations

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Also columns with names that operators use for their own.
WIDE = f"{DOCS}, score double, n_words long, key string, kept string, size string, items string, point string, _u string"

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards watch from a quiet hill and count every passing cloud".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + str(r.randrange(40)) for _ in range(n))


def edge_rows() -> list[tuple]:
    long = prose(1, 30_000)
    near = prose(2, 300)
    return [
        (1, None, None, None, None),
        (2, "", "en", "web", 0),
        (3, " \t\n \r\n", "en", "web", 5),
        (4, "one", None, "web", 3),
        (5, "one two three four", "en", None, 18),
        (None, "a text without an id, of some length, " + prose(3, 60), "de", "web", None),
        (None, None, None, None, None),
        (6, long, "en", "web", len(long)),
        (7, near, "en", "web", len(near)),
        (7, near, "en", "web", len(near)),
        (8, near, "en", "books", len(near)),
        (9, near + " and a tail", "en", "books", None),
        (10, "ÀÉ naïve café — 你好 世界 \U0001f600 x\x00y z w", "fr", "web", 30),
        (11, "1234 5678 !!! ???", "en", "web", 17),
        (12, "word " * 5000, "en", "web", 25_000),
        (13, "same line\n" * 500, "de", "web", 5000),
    ]


def edge_docs(spark, wide: bool = False):
    rows = edge_rows()
    if wide:
        return spark.createDataFrame([(*r, 0.5, 1, "k", "k", "s", "i", "p", "u") for r in rows], WIDE)
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def fold(i, n: int) -> int:
    return zlib.crc32(b"" if i is None else str(i).encode()) % n
