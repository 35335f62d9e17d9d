"""Small helpers for functions that Spark calls with Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def id_and_text(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the key, the text (as ``_text``, null as empty) and carried columns, so that no other can clash."""
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    return docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *carried)


def key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each take about ``most`` bytes; a longer text is alone."""
    for batch in batches:
        start, used = 0, 0
        for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if used and used + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)
