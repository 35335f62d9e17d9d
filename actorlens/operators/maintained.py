"""Behaviour features of entities that are kept up to date batch by batch.

The state is three kinds of stored tables:

* ``ticks`` (entity, block, time, rows): when an entity was seen, without anything else of the events.
  Blocks are spans of time of equal width. Every batch adds a table of its own; after ``most_parts``
  batches they become one again.
* ``blocks``: rows, first and last tick, and count, sum and squared deviations of the gaps inside each
  (entity, block).
* ``values`` (entity, output, value, rows): the distinct values seen, and under no output the rows.

A batch may hold ticks of any time, earlier ones too. Only the ticks of the (entity, block) pairs it
touches are read again; all other blocks keep their summary. Old events are never read. Gaps between
blocks follow from first and last ticks, so features come from the summaries alone, and merging
them is exact: sums are whole numbers, squared deviations are merged around the common mean.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actorlens.operators.gaps import SEGMENT_ROWS, tick_gaps
from actorlens.operators.joins import join_on
from actorlens.sources.storage import materialise

BLOCK = ["_entity", "_block"]


def _summaries(ticks: DataFrame, cutoff: int, segment_rows: int) -> DataFrame:
    """One row per (entity, block) of its ticks."""
    seen = tick_gaps(ticks, BLOCK, "_time", [F.sum("_rows").alias("_events")], segment_rows)
    kept = F.when(F.col("gap") < cutoff, F.col("gap"))
    return seen.groupBy(*BLOCK).agg(
        F.min("_time").alias("_first"),
        F.max("_time").alias("_last"),
        F.sum(F.when(F.lit(cutoff > 0), F.col("_events") - 1).otherwise(0)).alias("_zeros"),
        F.count(kept).alias("_gaps"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("_total"),
        (F.coalesce(F.var_pop(kept), F.lit(0.0)) * F.count(kept)).alias("_spread"),
    )


@dataclass(frozen=True)
class MaintainedFeatures:
    """Features of ``entity`` by the ticks in ``time``; ``distinct`` maps outputs to columns.

    ``add`` leaves the state as it is and returns the next one.
    """

    spark: SparkSession
    entity: str
    time: str
    distinct: dict[str, str]
    cutoff: int
    width: int
    most_parts: int = 8
    segment_rows: int = SEGMENT_ROWS
    ticks: tuple[DataFrame, ...] = field(default=())
    blocks: DataFrame | None = None
    values: DataFrame | None = None

    def add(self, batch: DataFrame) -> MaintainedFeatures:
        """The state after a batch of events; events without an entity are left out."""
        known = batch.filter(F.col(self.entity).isNotNull())
        values = self._merged_values(known)
        block = F.floor(F.col(self.time) / self.width).cast("bigint")
        ticks = known.filter(F.col(self.time).isNotNull()).groupBy(
            F.col(self.entity).alias("_entity"), block.alias("_block"), F.col(self.time).alias("_time")
        )
        added = materialise(ticks.agg(F.count("*").alias("_rows")))
        touched = materialise(added.select(*BLOCK).distinct())
        stored = [join_on(part, touched, BLOCK, "left_semi") for part in self.ticks]
        fresh = _summaries(reduce(DataFrame.unionByName, stored, added), self.cutoff, self.segment_rows)
        if self.blocks is not None:
            fresh = join_on(self.blocks, touched, BLOCK, "left_anti").unionByName(fresh)
        return replace(self, ticks=self._compacted(added), blocks=materialise(fresh), values=materialise(values))

    def _compacted(self, added: DataFrame) -> tuple[DataFrame, ...]:
        parts = (*self.ticks, added)
        if len(parts) <= self.most_parts:
            return parts
        whole = reduce(DataFrame.unionByName, parts).groupBy(*BLOCK, "_time").agg(F.sum("_rows").alias("_rows"))
        return (materialise(whole),)

    def _merged_values(self, known: DataFrame) -> DataFrame:
        """Distinct values of the state and of a batch; the empty output counts the rows."""
        pairs = [known.select(F.col(self.entity).alias("_entity"), F.lit("").alias("_output"), F.lit(None).cast("string").alias("_value"))]
        for output, column in self.distinct.items():
            pairs.append(
                known.filter(F.col(column).isNotNull()).select(
                    F.col(self.entity).alias("_entity"), F.lit(output).alias("_output"), F.col(column).cast("string").alias("_value")
                )
            )
        counted = [p.groupBy("_entity", "_output", "_value").agg(F.count("*").alias("_rows")) for p in pairs]
        if self.values is not None:
            counted.append(self.values)
        merged = reduce(DataFrame.unionByName, counted)
        return merged.groupBy("_entity", "_output", "_value").agg(F.sum("_rows").alias("_rows"))

    def gap_stats(self, scale: float = 1.0) -> DataFrame:
        """(entity, gaps, avg_gap, sd_gap) out of the summaries."""
        between = F.col("_first") - F.lag("_last").over(W.partitionBy("_entity").orderBy("_block"))
        joined = self.blocks.withColumn("_between", between)
        kept = F.col("_between") < self.cutoff

        def group(n: Column, total: Column, spread: Column) -> Column:
            return F.struct(n.cast("bigint").alias("n"), total.cast("bigint").alias("total"), spread.alias("spread"))

        none = F.lit(0)
        groups = F.array(
            group(F.col("_gaps"), F.col("_total"), F.col("_spread")),
            group(F.when(kept, 1).otherwise(0), F.when(kept, F.col("_between")).otherwise(0), F.lit(0.0)),
            group(F.col("_zeros"), none, F.lit(0.0)),
        )
        long = joined.select("_entity", F.inline(groups))
        whole = W.partitionBy("_entity")
        all_gaps = F.sum("n").over(whole)
        mean = F.sum("total").over(whole) / F.nullif(all_gaps, F.lit(0))
        off = F.col("total") / F.nullif(F.col("n"), F.lit(0)) - F.col("_mean")
        merged = long.withColumns({"_all": all_gaps, "_mean": mean}).groupBy("_entity").agg(
            F.sum("n").alias("gaps"),
            (F.first("_mean") / scale).alias("avg_gap"),
            F.sum(F.col("spread") + F.coalesce(F.col("n") * off * off, F.lit(0.0))).alias("_squares"),
        )
        sd = F.sqrt(F.col("_squares") / F.when(F.col("gaps") > 1, F.col("gaps") - 1)) / scale
        return merged.select(F.col("_entity").alias(self.entity), "gaps", "avg_gap", sd.alias("sd_gap"))

    def features(self, scale: float = 1.0, rows: str = "bids") -> DataFrame:
        """The columns of ``entity_features`` over all events so far."""
        if self.values is None or self.blocks is None:
            raise ValueError("no batch has been added")
        counts = self.values.groupBy(F.col("_entity").alias(self.entity)).agg(
            *[F.count_if(F.col("_output") == output).alias(output) for output in self.distinct],
            F.sum(F.when(F.col("_output") == "", F.col("_rows")).otherwise(0)).alias(rows),
        )
        logs = self.gap_stats(scale).select(
            self.entity, F.log1p("avg_gap").alias("avg_bid_interval"), F.log1p("sd_gap").alias("sd_bid_interval")
        )
        return counts.join(logs, self.entity, "left")
