"""Row numbers and running totals over a whole table without a single-task window.

Two ways, both exact:

* ``digest_rank`` and ``first_by_digest`` order by the MD5 of a key. A digest's leading hex digits
  cut any set of distinct keys into equal slices, so the plan stays lazy: count the slices, add up
  the slices before each, and number the rows inside a slice. How many digits are taken follows
  from the size of the group: one of few rows is one slice.
* ``running_before`` orders by values. It range-partitions, which also balances skewed values,
  writes the partitioned rows once, and adds the totals of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actorlens.operators.joins import join_on
from actorlens.sources.storage import materialise

BEFORE = (W.unboundedPreceding, -1)

#: Rows up to which a group is one slice. A larger one has slices of a sixteenth of this at least.
SLICE_ROWS = 4096


def digest(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def with_slices(df: DataFrame, groups: list[str], key: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``_digest`` and ``_slice``: as many of its leading digits as the group's size asks for.

    Only large groups are looked up; there are at most rows / ``slice_rows`` of them.
    """
    large = df.groupBy(*groups).agg(F.count("*").alias("_n")).filter(F.col("_n") > slice_rows)
    digits = F.ceil(F.log(16.0, F.col("_n") / slice_rows)).cast("int")
    marked = join_on(df, large.select(*groups, F.least(digits, F.lit(32)).alias("_digits")), groups, "left")
    sliced = marked.withColumn("_digest", digest(key))
    part = F.substring(F.col("_digest"), F.lit(1), F.coalesce(F.col("_digits"), F.lit(0)))
    return sliced.withColumn("_slice", part).drop("_digits")


def _slice_offsets(sliced: DataFrame, groups: list[str]) -> DataFrame:
    """Rows per (group, slice), rows of the group's slices before it, and rows of the group."""
    per_group = W.partitionBy(*groups)
    earlier = per_group.orderBy("_slice").rowsBetween(*BEFORE)
    return (
        sliced.groupBy(*groups, "_slice")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("group_rows", F.sum("_rows").over(per_group))
    )


def digest_rank(df: DataFrame, groups: list[str], key: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``rank`` (1..n by MD5 of ``key`` within the groups) and ``group_rows`` (n).

    ``key`` has to be unique within a group.
    """
    sliced = with_slices(df, groups, key, slice_rows)
    slices = _slice_offsets(sliced, groups).drop("_rows")
    joined = join_on(sliced, slices, [*groups, "_slice"])
    inside = W.partitionBy(*groups, "_slice").orderBy("_digest", key)
    return joined.withColumn("rank", F.col("_offset") + F.row_number().over(inside)).drop(
        "_digest", "_slice", "_offset"
    )


def first_by_digest(
    df: DataFrame, groups: list[str], key: str, share: float, output: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Mark the first floor(share * n) rows of each group by MD5 of ``key``.

    Only the one slice of a group that the limit falls into is sorted, to find the digest at the
    limit; all other rows are compared with that digest where they are, without a shuffle.
    """
    sliced = with_slices(df, groups, key, slice_rows)
    limit = F.floor(F.lit(share) * F.col("group_rows"))
    cut_slices = (
        _slice_offsets(sliced.select(*groups, "_slice"), groups)
        .filter((F.col("_offset") < limit) & (limit <= F.col("_offset") + F.col("_rows")))
        .select(*groups, "_slice", (limit - F.col("_offset")).alias("_nth"))
    )
    in_cut_slice = join_on(sliced.select(*groups, "_slice", "_digest"), cut_slices, [*groups, "_slice"])
    place = F.row_number().over(W.partitionBy(*groups).orderBy("_digest"))
    cuts = (
        in_cut_slice.withColumn("_place", place)
        .filter(F.col("_place") == F.col("_nth"))
        .select(*groups, F.col("_digest").alias("_cut"))
    )
    marked = join_on(sliced, cuts, groups, "left")
    return marked.withColumn(
        output, F.coalesce(F.col("_digest") <= F.col("_cut"), F.lit(False))
    ).drop("_digest", "_slice", "_cut")


def running_before(
    df: DataFrame, order: list[str], totals: list[str], groups: list[str] | None = None, descending: bool = False
) -> DataFrame:
    """Add ``before_<c>`` for each total: its sum over the group's rows that sort earlier.

    The order columns have to be unique within a group. The rows are written to the shared
    folder once, since the partitions have to be the same for the totals and for the rows.
    """
    groups = groups or []
    direction = F.desc if descending else F.asc
    ordering = [*[F.asc(g) for g in groups], *[direction(c) for c in order]]
    parts = materialise(
        df.repartitionByRange(*ordering).withColumn("_part", F.spark_partition_id())
    )
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(*BEFORE)
    offsets = parts.groupBy(*groups, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    offsets = offsets.select(
        *groups,
        "_part",
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_offset_{c}") for c in totals],
    )
    inside = (
        W.partitionBy(*groups, "_part").orderBy(*[direction(c) for c in order]).rowsBetween(*BEFORE)
    )
    joined = join_on(parts, offsets, [*groups, "_part"])
    added = {
        f"before_{c}": F.col(f"_offset_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
        for c in totals
    }
    return joined.withColumns(added).drop("_part", *[f"_offset_{c}" for c in totals])


def ordered_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Positions 0..n-1 of distinct rows in the order of the given columns."""
    numbered = running_before(df.withColumn("_one", F.lit(1).cast("bigint")), list(order), ["_one"])
    return numbered.withColumnRenamed("before__one", name).drop("_one")
