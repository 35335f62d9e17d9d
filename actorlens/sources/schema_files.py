"""Schema side files: one ``name<blank>type`` line per column, in table order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from actorlens.functions.columns import TYPE_WORDS, sanitise_names, type_word


def parse_schema_line(line: str) -> StructField:
    """One nullable field; anything but two words, or an unknown type word, is an error."""
    words = line.split()
    if len(words) != 2 or line[:1].isspace():
        raise ValueError(f"a schema line holds a name and a type: {line!r}")
    name, word = words
    if word.lower() not in TYPE_WORDS:
        raise ValueError(f"unknown column type {word!r}")
    return StructField(name, TYPE_WORDS[word.lower()], True)


def read_schema(spark: SparkSession, path: str) -> StructType:
    """The table schema described by a file on any file system Spark reads."""
    text = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(text) != 1:
        raise ValueError(f"{path} is not a single schema file")
    return StructType([parse_schema_line(line) for line in text[0]["value"].splitlines()])


def schema_lines(df: DataFrame) -> list[str]:
    """Tab-separated schema lines of a table, with dots in names replaced."""
    clean = sanitise_names(df)
    return [f"{f.name}\t{type_word(f.dataType)}" for f in clean.schema.fields]


def write_schema(df: DataFrame, path: str) -> None:
    """Write the schema of a table as one text file below ``path``."""
    lines = [(i, line) for i, line in enumerate(schema_lines(df))]
    table = df.sparkSession.createDataFrame(lines, "i int, value string")
    table.coalesce(1).sortWithinPartitions("i").select(F.col("value")).write.mode("overwrite").text(path)
