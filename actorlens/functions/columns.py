"""Column-list and type helpers over a table's schema."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    NumericType,
    StringType,
)


def sanitise_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores, so that names work in SQL expressions."""
    return df.toDF(*[re.sub(r"\.", "_", name) for name in df.columns])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop by name set; names that are not there are ignored."""
    return df.drop(*names)


def columns_of_type(df: DataFrame, *types: type[DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def continuous_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not plain integers: these get scaled and imputed."""
    return columns_of_type(df, DoubleType, FloatType, DecimalType, LongType)


def strict_cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast named columns; under ANSI mode a malformed value fails the job."""
    return df.withColumns({name: F.col(name).cast(t) for name, t in types.items()})


def to_model_types(df: DataFrame) -> DataFrame:
    """Every number as double, strings as they are: the types a feature vector takes."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return strict_cast(df, {name: "double" for name in numeric})


def drop_null_rows(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def fill_constant(df: DataFrame, names: Iterable[str], value: float) -> DataFrame:
    return df.fillna({name: value for name in names})


def is_missing(name: str, dtype: DataType) -> Column:
    """Null, or NaN where the type has one."""
    col = F.col(name)
    if isinstance(dtype, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


# The four type words of a schema file and the types they name.
TYPE_WORDS = {
    "double": DoubleType(),
    "string": StringType(),
    "decimal": DecimalType(38, 0),
    "int": IntegerType(),
}


def type_word(dtype: DataType) -> str:
    """The schema-file word of a Spark type."""
    if isinstance(dtype, (DoubleType, FloatType)):
        return "double"
    if isinstance(dtype, StringType):
        return "string"
    if isinstance(dtype, (LongType, DecimalType)):
        return "decimal"
    if isinstance(dtype, IntegerType):
        return "int"
    raise ValueError(f"no schema word for type {dtype.simpleString()}")
