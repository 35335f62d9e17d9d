"""Feature vectors from a table with numeric columns and categorical columns with factor maps.

A factor map gives each level of a column its index 0..n-1. Maps stay tables: rows meet their
indices by joins, and the driver only knows how many levels a column has.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


@dataclass
class Vocabulary:
    """Factor maps (column, level, idx), and the number of levels by column."""

    maps: DataFrame
    sizes: dict[str, int]


def vocabulary(factor_maps: DataFrame, columns: Iterable[str]) -> Vocabulary:
    """The maps of the columns; of ``columns`` those without any level are empty.

    Indices have to be 0..n-1, which is checked by their number, distinct number and extremes.
    """
    columns = list(columns)
    maps = factor_maps.filter(F.col("column").isin(columns))
    counts = maps.groupBy("column").agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    # Counted by level and by index in turn, as no row has to be expanded then.
    levels, places = ({r["column"]: r["count"] for r in maps.select("column", c).distinct().groupBy("column").count().collect()} for c in ("level", "idx"))
    sizes = dict.fromkeys(columns, 0)
    for row in counts.collect():
        column = row["column"]
        if {levels[column], places[column], row["high"] + 1} != {row["n"]} or row["low"] != 0:
            raise ValueError(f"the indices of {column} have to be 0..n-1, one for each level")
        sizes[column] = row["n"]
    return Vocabulary(maps, sizes)


def from_lists(spark: SparkSession, levels: dict[str, list[str]]) -> Vocabulary:
    """A vocabulary of levels listed in index order."""
    rows = [(column, level, float(i)) for column, names in levels.items() for i, level in enumerate(names)]
    maps = spark.createDataFrame(rows, "column string, level string, idx double")
    return Vocabulary(maps, {column: len(names) for column, names in levels.items()})


def feature_columns(df: DataFrame, sizes: dict[str, int], dropped: Iterable[str]) -> list[str]:
    """Columns that enter the vector, in table order; a string column needs a vocabulary."""
    indices = {f"{c}_idx" for c in sizes}
    names = [c for c in df.columns if c not in set(dropped) | indices]
    for name in names:
        dtype = df.schema[name].dataType
        if name in sizes:
            if not isinstance(dtype, StringType):
                raise ValueError(f"categorical column {name} is not a string")
        elif not isinstance(dtype, NumericType):
            raise ValueError(f"column {name} is neither numeric nor in a vocabulary")
    return names


def indexed(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add ``<column>_idx`` for every vocabulary column of the table that has none yet.

    An unknown level or null gets the size of the vocabulary. The number of categories travels as
    metadata, which trees and the one-hot encoder read.
    """
    for column, size in vocabulary.sizes.items():
        name = f"{column}_idx"
        if column not in df.columns:
            continue
        if name not in df.columns:
            levels = vocabulary.maps.filter(F.col("column") == column).select(
                F.col("level").alias("_level"), F.col("idx").alias("_idx")
            )
            df = df.join(levels, F.col(column) == F.col("_level"), "left").drop("_level")
            df = df.withColumn(name, F.coalesce(F.col("_idx").cast("double"), F.lit(float(size)))).drop("_idx")
        kind = {"ml_attr": {"type": "nominal", "name": name, "num_vals": size + 1}}
        df = df.withMetadata(name, kind)
    return df


def indexed_by_fold(df: DataFrame, fold_maps: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_idx`` by the map of each row's own ``fold``; an unknown level gets the size of that map.

    ``fold_maps`` has (fold, column, level, idx), so rows meet a vocabulary made without them.
    """
    maps = fold_maps.filter(F.col("column") == column)
    sizes = maps.groupBy(F.col("fold").alias("_fold")).agg(F.count("*").cast("double").alias("_size"))
    levels = maps.select(F.col("fold").alias("_in"), F.col("level").alias("_level"), F.col("idx").alias("_idx"))
    met = df.join(levels, (F.col("fold") == F.col("_in")) & (F.col(column) == F.col("_level")), "left")
    met = met.join(sizes, F.col("fold") == F.col("_fold"), "left")
    index = F.coalesce("_idx", "_size", F.lit(0.0))
    return met.withColumn(f"{column}_idx", index).drop("_in", "_level", "_idx", "_fold", "_size")


def encoding_stages(
    columns: list[str], sizes: dict[str, int], one_hot: bool = False, output: str = "features"
) -> list[Transformer | Estimator]:
    """Pipeline stages from the columns of an ``indexed`` table to one vector.

    Ordinal: a level is its index. One-hot: a block per column, as wide as its vocabulary, all zero
    for an unknown level or null.
    """
    if one_hot:
        # The block of an empty vocabulary has no width.
        columns = [c for c in columns if sizes.get(c, True)]
    factors = [c for c in columns if c in sizes]
    stages: list[Transformer | Estimator] = []
    suffix = "_idx"
    if one_hot and factors:
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}_idx" for c in factors],
                outputCols=[f"{c}_block" for c in factors],
                dropLast=True,
            )
        )
        suffix = "_block"
    inputs = [c + suffix if c in sizes else c for c in columns]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error"))
    return stages


def encode(
    df: DataFrame,
    vocabulary: Vocabulary,
    dropped: Iterable[str] = (),
    one_hot: bool = False,
    output: str = "features",
) -> DataFrame:
    """The table with its feature vector appended: keys and vector stay in one row."""
    columns = feature_columns(df, vocabulary.sizes, dropped)
    with_indices = indexed(df, vocabulary)
    pipeline = Pipeline(stages=encoding_stages(columns, vocabulary.sizes, one_hot, output))
    return pipeline.fit(with_indices).transform(with_indices).select(*df.columns, output)


def labelled(
    df: DataFrame, outcome: str, label_levels: list[str] | None = None, output: str = "label"
) -> DataFrame:
    """Add a numeric label: the outcome as double, or the position of its level."""
    if label_levels is None:
        return df.withColumn(output, F.col(outcome).cast("double"))
    indexer = StringIndexerModel.from_labels(
        label_levels, inputCol=outcome, outputCol=output, handleInvalid="error"
    )
    return indexer.transform(df)


def categorical_arity(encoded: DataFrame, output: str = "features") -> dict[int, int]:
    """Vector position -> number of categories, the unknown bucket included."""
    attributes = encoded.schema[output].metadata.get("ml_attr", {}).get("attrs", {})
    return {a["idx"]: a.get("num_vals") or len(a["vals"]) for a in attributes.get("nominal", [])}


def explode_vector(encoded: DataFrame, keys: list[str], output: str = "features", sparse: bool = False) -> DataFrame:
    """One row per vector position; with ``sparse`` only the entries that are not zero."""
    long = encoded.select(*keys, F.posexplode(vector_to_array(output)).alias("pos", "value"))
    return long.filter("value <> 0") if sparse else long
