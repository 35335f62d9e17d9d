"""Time between consecutive events of an entity or within an auction.

Rows first collapse to one per (key, tick): rows that share a tick are zero ticks apart, so a
count replaces them. The ticks of keys with many rows are then swept: a range partitioner lays them
out in order, cut into segments of equal count, and the last tick of a key in one moves on to the
next, so no window sorts a whole hot key and no gap is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from actorlens.operators.joins import join_on
from actorlens.operators.profiles import distinct_profile
from actorlens.sources.storage import materialise

SEGMENT_ROWS = 1_000_000
PARTS_PER_CORE = 4


def _hot_keys(facts: DataFrame, keys: list[str], segment_rows: int) -> tuple[DataFrame, int]:
    """Keys with more than ``segment_rows`` rows, and how many rows these have in all."""
    counts = facts.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > segment_rows)
    hot = materialise(counts)
    return hot.select(*keys), hot.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]


def sweep(ticks: DataFrame, keys: list[str], time: str, rows: int, segment_rows: int) -> DataFrame:
    """``ticks`` in order of keys and time with ``_segment``: numbers of runs of ``segment_rows``, rising with the order.

    A range partitioner lays the ticks out, wherever in time they lie, in no more parts than the
    cluster works on at a time; each part is cut in order. The result is stored, as the segments have
    to stay the same for the ticks and for what is carried from one to the next.
    """
    most = PARTS_PER_CORE * ticks.sparkSession.sparkContext.defaultParallelism
    placed = ticks.repartitionByRange(max(1, min(-(-rows // segment_rows), most)), *keys, time)
    # The upper bits of the id are the part, the lower ones count its rows.
    part = F.shiftright(F.col("_at"), 33)
    run = F.floor((F.col("_at") - F.shiftleft(part, 33)) / segment_rows)
    numbered = placed.sortWithinPartitions(*keys, time).withColumn("_at", F.monotonically_increasing_id())
    return materialise(numbered.withColumn("_segment", F.shiftleft(part, 33) + run).drop("_at"))


def _carried(placed: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The last tick of a key before each segment that goes on with the key, as a row without events."""
    ends = placed.groupBy(*keys, "_segment").agg(F.max(time).alias("_last"))
    earlier = F.lag("_last").over(W.partitionBy(*keys).orderBy("_segment"))
    rows = ends.select(*keys, "_segment", earlier.alias(time), F.lit(0).cast("bigint").alias("rows"))
    return rows.filter(F.col(time).isNotNull())


def segmented_tick_gaps(
    facts: DataFrame,
    keys: list[str],
    time: str,
    payload: list[Column] | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One row per (key, tick): ``rows``, the aggregates of ``payload``, ``gap`` and ``_segment``.

    ``gap`` is the distance to the key's previous tick, null for its first. Ordinary keys are one
    segment each, hot ones are swept in several.
    """

    def ticks(some: DataFrame) -> DataFrame:
        return some.groupBy(*keys, time).agg(F.count("*").alias("rows"), *(payload or []))

    def gap(*within: str) -> Column:
        return F.col(time) - F.lag(time).over(W.partitionBy(*within).orderBy(time))

    hot, rows = _hot_keys(facts, keys, segment_rows)
    if not rows:
        return ticks(facts).withColumns({"_segment": F.lit(0).cast("bigint"), "gap": gap(*keys)})
    cold = ticks(join_on(facts, hot, keys, "left_anti"))
    placed = sweep(ticks(join_on(facts, hot, keys, "left_semi")), keys, time, rows, segment_rows)
    swept = placed.unionByName(_carried(placed, keys, time), allowMissingColumns=True)
    swept = swept.withColumn("gap", gap(*keys, "_segment")).filter(F.col("rows") > 0)
    return cold.withColumns({"_segment": F.lit(0).cast("bigint"), "gap": gap(*keys)}).unionByName(swept)


def tick_gaps(
    facts: DataFrame,
    keys: list[str],
    time: str,
    payload: list[Column] | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``segmented_tick_gaps`` without the segment."""
    return segmented_tick_gaps(facts, keys, time, payload, segment_rows).drop("_segment")


def with_zeros(gap: Column, zeros: Column, scale: float) -> tuple[Column, Column, Column]:
    """Aggregates count, mean and sample sd of non-null gaps plus a number of zero gaps.

    Gaps are whole ticks, so their sum is exact in any order. The zeros join as a group of their
    own with mean 0, which needs no per-row copies.
    """
    seen = F.count(gap)
    zero_rows = F.coalesce(F.sum(zeros), F.lit(0))
    rows = seen + zero_rows
    total = F.coalesce(F.sum(gap), F.lit(0))
    mean = total / F.nullif(seen, F.lit(0)) / scale
    inner = F.coalesce(F.var_pop(gap / scale), F.lit(0.0)) * seen
    between = F.coalesce(mean * mean * seen, F.lit(0.0)) * zero_rows / F.nullif(rows, F.lit(0))
    return (
        rows,
        total / F.nullif(rows, F.lit(0)) / scale,
        F.sqrt((inner + between) / F.when(rows > 1, rows - 1)),
    )


def gap_stats(
    facts: DataFrame,
    keys: list[str],
    time: str,
    cutoff: int,
    scale: float = 1.0,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Count, mean and sample sd of each key's gaps below ``cutoff``, in units of ``scale`` ticks.

    A key without a kept gap has null mean, one with a single kept gap has null sd.
    """
    ticks = tick_gaps(facts, keys, time, segment_rows=segment_rows)
    kept = F.when(F.col("gap") < cutoff, F.col("gap"))
    zeros = F.when(F.col(time).isNotNull() & F.lit(cutoff > 0), F.col("rows") - 1)
    count, mean, sd = with_zeros(kept, zeros, scale)
    return ticks.groupBy(*keys).agg(
        count.alias("gaps"), mean.alias("avg_gap"), sd.alias("sd_gap")
    )


def responder_gap_stats(
    facts: DataFrame,
    group: str,
    time: str,
    order: str,
    label: str,
    cutoff: int,
    scale: float = 1.0,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Gap statistics per group, split by the label of the row that ended the gap.

    ``facts`` holds all rows, also those without a label: they end gaps that count for neither
    side. Rows of one tick follow each other by ``order``: the first ends the gap to the tick
    before, the rest end zero gaps.
    """
    is_human, is_bot = F.col(label) == 0, F.col(label) == 1
    payload = [
        F.min(F.struct(order, label))[label].alias("_first_label"),
        F.count_if(is_human).alias("_humans"),
        F.count_if(is_bot).alias("_bots"),
    ]
    ticks = tick_gaps(facts, [group], time, payload, segment_rows)
    kept = F.when(F.col("gap") < cutoff, F.col("gap"))
    outputs = []
    for name, value, rows in (("human", 0, "_humans"), ("bot", 1, "_bots")):
        first = F.coalesce(F.col("_first_label") == value, F.lit(False))
        timed = F.col(time).isNotNull() & F.lit(cutoff > 0)
        zeros = F.when(timed, F.col(rows) - first.cast("bigint"))
        count, mean, sd = with_zeros(F.when(first, kept), zeros, scale)
        outputs += [
            count.alias(f"{name}_gaps"),
            mean.alias(f"{name}_avg"),
            sd.alias(f"{name}_sd"),
        ]
    return ticks.groupBy(group).agg(*outputs)


def entity_features(
    facts: DataFrame,
    entity: str,
    time: str,
    distinct: dict[str, str],
    cutoff: int,
    scale: float = 1.0,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Behaviour of each entity: distinct counts, rows, log mean and log sd of its gaps.

    Facts without an entity make no row.
    """
    counts = distinct_profile(facts, entity, distinct)
    stats = gap_stats(facts, [entity], time, cutoff, scale, segment_rows)
    # A plain join, as both sides are already partitioned by the entity.
    logs = stats.select(
        entity,
        F.log1p("avg_gap").alias("avg_bid_interval"),
        F.log1p("sd_gap").alias("sd_bid_interval"),
    )
    return counts.join(logs, entity)


def apply_to_segments(
    facts: DataFrame,
    keys: list[str],
    time: str,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: DataType | str,
    merge: list[Column],
    payload: list[Column] | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Summarise the ticks of each key with a pandas function, and merge the summaries.

    The function gets ticks of one key in order (keys, time, rows, gap and the aggregates of
    ``payload`` per tick, such as the set of ips) and returns rows of ``schema``, keys among them. It
    has to be partial: a key's ticks reach it in one piece or in several, gaps across their borders
    included. ``merge`` aggregates its rows to one per key, for every key alike, so no call ever needs
    all rows of a hot key and results do not depend on the pieces.
    """
    ticks = segmented_tick_gaps(facts, keys, time, payload, segment_rows)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return function(pdf.sort_values(time))

    partial = ticks.groupBy(*keys, "_segment").applyInPandas(call, schema)
    return partial.groupBy(*keys).agg(*merge)
