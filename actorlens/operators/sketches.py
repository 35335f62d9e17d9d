"""Tables of mergeable sketches: distinct counts and quantiles by small groups, rolled up to larger ones later.

A sketch table is stored once per batch or day. Rolling up reads sketches only, never the rows they
were made of, and tables of several batches are simply put together. Distinct counts are
HyperLogLog sketches (relative standard error about 1.04 / sqrt(2^lg)), quantiles KLL sketches (error of the
rank below 1.7 percent at k = 200).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actorlens.sources.storage import materialise

#: 2^14 registers: a standard error of 0.8 percent.
LG_REGISTERS = 14
KLL_K = 400


def sketch_table(
    df: DataFrame,
    groups: list[str],
    distinct: dict[str, str],
    quantiles: dict[str, str],
    lg: int = LG_REGISTERS,
    k: int = KLL_K,
    path: str | None = None,
) -> DataFrame:
    """One stored row per group: ``rows``, a sketch per distinct count and per quantile column (whole numbers).

    Nulls enter no sketch. Both arguments map outputs to columns.
    """
    made = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg)).alias(o) for o, c in distinct.items()]
    made += [F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), F.lit(k)).alias(o) for o, c in quantiles.items()]
    return materialise(df.groupBy(*groups).agg(F.count("*").alias("rows"), *made), path)


def roll_up(sketches: DataFrame, groups: list[str], distinct: list[str], quantiles: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    merged = [F.hll_union_agg(c).alias(c) for c in distinct] + [F.kll_merge_agg_bigint(c).alias(c) for c in quantiles]
    return sketches.groupBy(*groups).agg(F.sum("rows").alias("rows"), *merged)


def estimates(sketches: DataFrame, groups: list[str], distinct: list[str], quantiles: dict[str, dict[str, float]]) -> DataFrame:
    """Distinct counts, and the quantiles asked for by name and share of each quantile sketch; null of an empty one."""
    counted = [F.hll_sketch_estimate(c).alias(c) for c in distinct]
    read = [
        F.when(F.kll_sketch_get_n_bigint(c) > 0, F.kll_sketch_get_quantile_bigint(F.col(c), F.lit(share))).alias(name)
        for c, shares in quantiles.items()
        for name, share in shares.items()
    ]
    return sketches.select(*groups, "rows", *counted, *read)
