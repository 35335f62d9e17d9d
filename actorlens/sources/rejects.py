"""Delimited text whose bad lines are kept aside, each with its place, before the job fails on them.

A line is bad if it has too few or too many values, or a value that is not of its column's type. Places
are the file, the block of it that was read as one, and the line within the file, from 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from actorlens.sources.storage import materialise


class RejectedLines(ValueError):
    """Raised with the number of bad lines and the table that holds them all."""

    def __init__(self, lines: int, first: str, table: DataFrame):
        super().__init__(f"{lines} bad lines, such as {first}")
        self.lines, self.table = lines, table


@dataclass(frozen=True)
class CheckedTable:
    """``rows`` of the schema from the good lines, and ``rejects`` (file, block, line, column, reason, text)."""

    rows: DataFrame
    rejects: DataFrame

    def require(self) -> DataFrame:
        """The rows, if no line was bad."""
        found = self.rejects.agg(F.count("*").alias("n")).first()["n"]
        if found:
            row = self.rejects.orderBy("file", "line").first()
            raise RejectedLines(found, f"line {row['line']} of {row['file']}: {row['reason']}", self.rejects)
        return self.rows


def _value(values: Column, i: int, null_value: str | None) -> Column:
    """The text of a value; null if it is empty or stands for a missing one."""
    text = F.get(values, F.lit(i))
    return F.when(~(text == "" if null_value is None else text.isin("", null_value)), text)


def _reasons(values: Column, schema: StructType, null_value: str | None) -> Column:
    """struct<column, reason> of the first thing wrong with a line; null if nothing is."""
    found = F.size(values)
    wrong = F.when(
        found != len(schema),
        F.struct(F.lit(None).cast("string").alias("column"), F.concat(found.cast("string"), F.lit(f" values instead of {len(schema)}")).alias("reason")),
    )
    checks = []
    for i, field in enumerate(schema):
        if not isinstance(field.dataType, StringType):
            value = _value(values, i, null_value)
            bad = value.isNotNull() & F.trim(value).try_cast(field.dataType).isNull()
            checks.append((bad, F.struct(F.lit(field.name).alias("column"), F.concat(F.lit(f"no {field.dataType.simpleString()}: "), value).alias("reason"))))
    return reduce(lambda chain, check: chain.when(*check), checks, wrong)


def read_checked(
    spark: SparkSession, path: str | list[str], schema: StructType, null_value: str | None = None
) -> CheckedTable:
    """Read headerless comma-separated lines without quotes, bound by position.

    Lines are numbered within the blocks that tasks read, and blocks by the lines of the blocks of
    their file before. Bad lines are stored; a gzip file is one block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("text"),
    )
    values = F.split("text", ",", -1)
    judged = lines.withColumn("_wrong", _reasons(values, schema, null_value))
    # Lines of a block are numbered one after the other, whichever task reads it.
    blocks = lines.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
    bad = judged.filter(F.col("_wrong").isNotNull()).join(blocks, ["file", "block"])
    rejects = bad.select(
        "file", "block", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"),
        "_wrong.column", "_wrong.reason", "text",
    )
    good = judged.filter(F.col("_wrong").isNull())
    typed = [
        F.trim(_value(values, i, null_value)).cast(f.dataType).alias(f.name)
        if not isinstance(f.dataType, StringType)
        else _value(values, i, null_value).alias(f.name)
        for i, f in enumerate(schema)
    ]
    return CheckedTable(good.select(*typed), materialise(rejects))
