"""Counts and distinct counts by attribute and label, and what is derived from them.

Every aggregation here combines before its shuffle, so a hot attribute level or entity costs
one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actorlens.functions.expressions import negentropy


def count_by(df: DataFrame, *keys: str | Column, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def roll_up(counts: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Coarser counts out of finer ones."""
    return counts.groupBy(*keys).agg(F.sum(name).alias(name))


def pivot_counts(
    counts: DataFrame, key: str, label: str, names: dict[int, str], name: str = "count"
) -> DataFrame:
    """One row per key and one column per label value, zero where the pair does not occur."""
    wide = counts.groupBy(key).pivot(label, list(names)).agg(F.sum(name))
    wide = wide.withColumnsRenamed({str(value): column for value, column in names.items()})
    return wide.fillna(0, subset=list(names.values()))


def label_counts(facts: DataFrame, attribute: str | Column, label: str) -> DataFrame:
    """Rows per attribute level with label 0 (``humans``) and 1 (``bots``)."""
    return facts.groupBy(attribute).agg(
        F.count_if(F.col(label) == 0).alias("humans"),
        F.count_if(F.col(label) == 1).alias("bots"),
    )


def label_profile(
    facts: DataFrame, entities: DataFrame, attribute: str | list[str], entity: str, label: str
) -> DataFrame:
    """Rows and distinct entities per label for each level of any attribute.

    Facts shrink to one row per (level, entity) before they meet the labels, so the distinct
    entities of a level are plain row counts and no row is expanded per distinct column.
    """
    keys = [attribute] if isinstance(attribute, str) else attribute
    pairs = facts.groupBy(*keys, entity).agg(F.count("*").alias("_rows"))
    labelled = pairs.join(entities.select(entity, label), entity)
    human, bot = F.col(label) == 0, F.col(label) == 1
    return labelled.groupBy(*keys).agg(
        F.sum(F.when(human, F.col("_rows")).otherwise(0)).alias("humans"),
        F.sum(F.when(bot, F.col("_rows")).otherwise(0)).alias("bots"),
        F.count_if(human).alias("distinct_humans"),
        F.count_if(bot).alias("distinct_bots"),
    )


def label_profiles(
    facts: DataFrame, entities: DataFrame, attributes: list[str], entity: str, label: str
) -> DataFrame:
    """``label_profile`` of several attributes in one pass, as (attribute, level, ...)."""
    long = facts.select(entity, *attributes).unpivot(entity, attributes, "attribute", "level")
    return label_profile(long, entities, ["attribute", "level"], entity, label)


def distinct_profile(
    facts: DataFrame, entity: str, distinct: dict[str, str], rows: str = "bids", approximate: bool = False
) -> DataFrame:
    """Row count and several distinct counts per entity; ``distinct`` maps output to column.

    Exact by default: for each column, facts shrink to one row per (entity, value) in their tasks.
    ``approximate`` trades exactness for sketches that merge before the shuffle.
    """
    if approximate or not distinct:
        counts = [F.approx_count_distinct(F.col(column)).alias(output) for output, column in distinct.items()]
        return facts.groupBy(entity).agg(*counts, F.count("*").alias(rows))
    # A scan per column reads that column only; nothing is expanded. The rows count under no output.
    entities = facts.select(entity, F.lit("").alias("output"), F.lit(None).cast("string").alias("value"))
    values = [
        facts.select(entity, F.lit(o).alias("output"), F.col(c).cast("string").alias("value")).filter("value IS NOT NULL")
        for o, c in distinct.items()
    ]
    counted = [p.groupBy(entity, "output", "value").agg(F.count("*").alias("_rows")) for p in (entities, *values)]
    return reduce(DataFrame.unionByName, counted).groupBy(entity).agg(
        *[F.count_if(F.col("output") == o).alias(o) for o in distinct],
        F.sum(F.when(F.col("output") == "", F.col("_rows")).otherwise(0)).alias(rows),
    )


def attribute_informativeness(profile: DataFrame) -> DataFrame:
    """A label profile with the negative entropy of its label share."""
    return profile.withColumn(
        "negentropy", negentropy(F.col("bots"), F.col("humans") + F.col("bots"))
    )


def informative(profile: DataFrame, min_rows: int = 100, min_negentropy: float = -0.7) -> DataFrame:
    """Levels with more bot than human rows, enough rows, and a clear enough label share."""
    return profile.filter(
        (F.col("humans") < F.col("bots"))
        & (F.col("humans") + F.col("bots") > min_rows)
        & (F.col("negentropy") > min_negentropy)
    )


def coverage(selected: DataFrame) -> DataFrame:
    """How many levels were selected and how many bot rows they cover."""
    return selected.agg(
        F.count("*").alias("levels"), F.coalesce(F.sum("bots"), F.lit(0)).alias("bots")
    )


def below(profile: DataFrame, column: str, limit: int) -> DataFrame:
    """Levels whose aggregate stays below a limit."""
    return profile.filter(F.col(column) < limit)
