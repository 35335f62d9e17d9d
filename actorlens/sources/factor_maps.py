"""Factor maps: tab-separated ``level, index`` files, one per categorical column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actorlens.operators.encoding import Vocabulary, vocabulary


def read_factor_map(spark: SparkSession, path: str) -> DataFrame:
    """(level, idx); exactly two fields a line, and of a level given twice the last line holds.

    The last line is the one furthest down in the last file by name.
    """
    lines = spark.read.option("mode", "FAILFAST").option("sep", "\t").option("quote", "")
    table = lines.schema("level string, idx double").csv(path)
    # Within a block of a file ids ascend line by line.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    placed = table.withColumn("_line", place)
    return placed.groupBy("level").agg(F.max_by("idx", "_line").alias("idx"))


def write_factor_map(factor_map: DataFrame, path: str) -> None:
    """Write (level, idx) with whole-number indices, in index order."""
    lines = factor_map.orderBy("idx").select("level", F.col("idx").cast("bigint"))
    lines.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def write_factor_maps(factor_maps: DataFrame, paths: dict[str, str]) -> None:
    """Write each column of a (column, level, idx) table to its own file."""
    for column, path in paths.items():
        write_factor_map(factor_maps.filter(F.col("column") == column).drop("column"), path)


def read_vocabulary(spark: SparkSession, paths: dict[str, str]) -> Vocabulary:
    """The vocabulary of several columns from their factor map files."""
    return vocabulary(long_factor_maps(spark, paths), paths)


def long_factor_maps(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All maps in one (column, level, idx) table."""
    frames = [
        read_factor_map(spark, path).select(F.lit(column).alias("column"), "level", "idx")
        for column, path in paths.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
