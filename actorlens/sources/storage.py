"""Durable intermediate results: shared scratch folder, checkpoints, tables and models."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, from ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint folder exists (local runs and tests) is one
    made below the warehouse, which goes when the session ends.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(folder)
    folder = spark.sparkContext.getCheckpointDir()
    _forget_at_end(spark, folder)
    return folder


def _file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    """Hadoop's handle of a path and of the store it lies in."""
    handle = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _forget_at_end(spark: SparkSession, path: str) -> None:
    handle, store = _file_system(spark, path)
    store.deleteOnExit(handle)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        handle, store = _file_system(spark, path)
        store.delete(handle, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted with the session at the latest."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _forget_at_end(spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Run ``df`` once and go on from its copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write an expensive result as Parquet and read it back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "table")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """A typed table without rows, to derive the schema of a plan before data exists."""
    return spark.createDataFrame([], schema)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
