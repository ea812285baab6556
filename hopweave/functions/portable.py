"""Hash draws that any SQL engine can repeat, and a deterministic weight formula."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by colons: the order in which rows are drawn."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def draw_index(key: Column, n: Column) -> Column:
    """A number from 0 to n - 1, from the first 32 bits of a draw key."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), n)


def draw_unit(key: Column) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def weight(i: int, k: int) -> float:
    return ((i * 7 + k * 3) % 11 - 5) / 10


def weights(rows: int, columns: int) -> list[list[float]]:
    return [[weight(i, k) for k in range(columns)] for i in range(rows)]
