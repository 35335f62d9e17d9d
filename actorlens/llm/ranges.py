"""Cutting a table into ranges of sort keys that are known before the shuffle."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys drawn per range to place the borders; a larger sample evens the ranges out, nothing else.
DRAWN_PER_RANGE = 20


def ranges_wanted(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def borders(df: DataFrame, key: Sequence[Column], mark: Column, ranges: int) -> list[tuple[Any, ...]]:
    """Ascending keys that cut ``df`` into about equal ranges; any borders would be right.

    About DRAWN_PER_RANGE keys for each range are drawn by the hash of ``mark``.
    """
    if ranges < 2:
        return []
    places = 1 << 30
    share = min(1.0, DRAWN_PER_RANGE * ranges / max(1, df.count()))
    drawn = df.filter(F.pmod(F.xxhash64(mark), F.lit(places)) <= int(share * places))
    keys = sorted(tuple(r) for r in drawn.select(*[k.alias(f"_{i}") for i, k in enumerate(key)]).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def range_of(cuts: Sequence[tuple[Any, ...]], key: tuple[Any, ...]) -> int:
    """Number of the range that holds a key; a border belongs to the range it starts."""
    return bisect_right(cuts, key)
