"""Scalar expressions used by the profiles and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def negentropy(positives: Column, total: Column) -> Column:
    """``p log2 p + (1-p) log2(1-p)`` of a binary share, 0 where the share is pure."""
    p = positives.cast("double") / total
    return F.when((p == 0) | (p == 1), F.lit(0.0)).otherwise(
        p * F.log2(p) + (1 - p) * F.log2(1 - p)
    )


def floor_div(value: Column, width: Column) -> Column:
    """Integer division that rounds down for negative values too."""
    return F.call_function("div", value - F.pmod(value, width), width)


def time_bucket(time: Column, origin: Column, width: int) -> Column:
    """Index of the fixed-width bucket, counted from ``origin``, of an integer tick."""
    return floor_div(time - origin, F.lit(width).cast("bigint"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    second = F.floor(F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
        + F.hour(ts).cast("bigint") * 3_600_000_000
        + F.minute(ts).cast("bigint") * 60_000_000
        + second
    )


def share(condition: Column) -> Column:
    """Share of a group's rows that satisfy a condition (aggregate)."""
    return F.avg(condition.cast("double"))
