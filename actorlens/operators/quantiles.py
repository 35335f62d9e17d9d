"""Exact quantiles and box-plot statistics by group, without holding a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actorlens.operators.joins import join_on
from actorlens.operators.ordering import running_before
from actorlens.sources.storage import materialise


def value_distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Rows per (group, value) with the number of the group's rows that are smaller."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count("*").alias("_rows")
    )
    return running_before(counts, [value], ["_rows"], groups)


def quantiles(distribution: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation between the two nearest ranks; ``probs`` by output."""
    total = distribution.groupBy(*groups).agg(F.sum("_rows").alias("_total"))
    ranked = join_on(distribution, total, groups)
    first, last = F.col("before__rows"), F.col("before__rows") + F.col("_rows")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < last), F.col(value).cast("double")))

    outputs = []
    for name, p in probs.items():
        if not 0 <= p <= 1 or math.isnan(p):
            raise ValueError(f"not a probability: {p}")
        target = F.lit(p) * (F.col("_total") - 1)
        low, high = at(F.floor(target)), at(F.ceil(target))
        weight = F.max(target - F.floor(target))
        outputs.append((low + (high - low) * weight).alias(name))
    return ranked.groupBy(*groups).agg(F.max("_total").alias("n"), *outputs)


def boxplot_stats(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and outliers."""
    distribution = materialise(value_distribution(df, groups, value))
    boxes = quantiles(distribution, groups, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value).cast("double")
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    whiskers = (
        join_on(distribution, boxes, groups)
        .groupBy(*groups)
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_rows"))).alias("outliers"),
        )
    )
    return join_on(boxes, whiskers, groups)


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per (ids, metric), so that one pass gives the box plots of several metrics."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(ids, metrics, "metric", "value")
