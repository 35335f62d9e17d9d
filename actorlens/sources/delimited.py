"""Delimited text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from actorlens.functions.columns import to_model_types


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    null_value: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Headerless comma-separated rows bound by position; a malformed row fails the job.

    Compressed files are read by suffix. A gzip file is one task, so ``partitions`` spreads its
    rows before further work; large inputs are better kept as several files.
    """
    options = {"mode": "FAILFAST", "quote": "", "header": "false", "sep": ","}
    if null_value is not None:
        options["nullValue"] = null_value
    df = spark.read.schema(schema).options(**options).csv(path)
    return df.repartition(partitions) if partitions else df


def require_values(df: DataFrame, *names: str) -> DataFrame:
    """Fail the job on a null in the named columns (all numeric ones by default)."""
    names = names or tuple(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType))
    checked = {
        n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"missing value in column {n}")).cast(df.schema[n].dataType)).otherwise(F.col(n))
        for n in names
    }
    return df.withColumns(checked)


def read_model_table(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """``read_table`` with every number as double and none of them missing."""
    return to_model_types(require_values(read_table(spark, path, schema)))


def read_with_header(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    """Comma-separated rows with a header line; types are inferred where no schema is given."""
    reader = spark.read.option("header", "true")
    if schema is None:
        return reader.option("inferSchema", "true").csv(path)
    return reader.schema(schema).option("mode", "FAILFAST").csv(path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files, decompressed by suffix."""
    return spark.read.text(path)


def write_table(df: DataFrame, path: str, null_value: str = "NA", compression: str | None = None) -> None:
    """Comma-separated text without header or quotes."""
    writer = df.write.mode("overwrite").option("header", "false").option("quote", "")
    writer = writer.option("nullValue", null_value).option("emptyValue", "")
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def write_scored(df: DataFrame, path: str) -> None:
    """Scored rows ``bid_id,bidder_id,outcome,pred``, as text."""
    write_table(df.select("bid_id", "bidder_id", "outcome", "pred"), path)


def write_submission(df: DataFrame, path: str, key: str = "bidder_id") -> None:
    """Entity scores ``key,prob``, as text."""
    write_table(df.select(key, "prob"), path)
