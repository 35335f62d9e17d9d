"""Exact sets of levels as bitmaps, which merge without the rows they were made of.

Levels have dense indices 0..n-1 from a factor map. A set is rows (groups, word, bits): word w has a bit
for each of the levels 64 w to 64 w + 63. Only words with a level are there, so small sets stay small,
and a large one is spread over many rows instead of one long bitmap. Sets are made and merged by
``bit_or``, which combines in each task before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def level_sets(facts: DataFrame, groups: list[str], column: str, factor_map: DataFrame) -> DataFrame:
    """(groups, word, bits) of the levels of ``column`` that each group holds; levels without an index are left out."""
    levels = factor_map.select(F.col("level").alias("_level"), F.col("idx").cast("bigint").alias("_idx"))
    pairs = facts.select(*groups, F.col(column).cast("string").alias("_level"))
    bit = F.expr(f"shiftleft(1L, int(_idx % {WORD}))")
    return pairs.join(levels, "_level").groupBy(*groups, F.expr(f"_idx div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))


def merge(sets: DataFrame, groups: list[str]) -> DataFrame:
    """Sets of coarser groups: the union of those of the finer ones."""
    return sets.groupBy(*groups, "word").agg(F.bit_or("bits").alias("bits"))


def set_size() -> Column:
    """Aggregate: number of levels of a set."""
    return F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint")


def shared(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """The intersection of the sets of equal groups."""
    other = right.withColumnRenamed("bits", "_bits")
    both = left.join(other, [*groups, "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("_bits")))
    return both.drop("_bits").filter("bits <> 0")


def members(sets: DataFrame, groups: list[str], factor_map: DataFrame) -> DataFrame:
    """(groups, level) of every member."""
    spread = sets.selectExpr(*groups, f"explode(filter(sequence(0, {WORD - 1}), i -> shiftright(bits, i) & 1 = 1)) AS _bit", "word")
    indexed = spread.selectExpr(*groups, f"word * {WORD} + _bit AS _idx")
    levels = factor_map.select("level", F.col("idx").cast("bigint").alias("_idx"))
    return indexed.join(levels, "_idx").select(*groups, "level")
