"""Joins between a fact table (events) and a dimension of entities.

The plain joins carry no hints: Spark broadcasts a side whose measured size is small and its
adaptive skew join splits hot keys. ``hot_rows`` asks for explicit salting instead, for plans
in which the adaptive split cannot apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and their row count.

    At most rows / hot_rows keys qualify, which bounds the table however large ``df`` is.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("key_rows"))
    return counts.filter(F.col("key_rows") > hot_rows)


def salted_join(
    facts: DataFrame, entities: DataFrame, key: str, how: str = "inner", hot_rows: int = 5_000_000
) -> DataFrame:
    """Inner or left join of facts to entities with the facts of hot keys spread over salts.

    Each hot key gets one salt per ``hot_rows`` rows; its entity row is repeated once per salt, so
    every fact still meets its entity exactly once. The table of hot keys grows with the facts, so
    how it is joined is left to its measured size.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join supports inner and left, not {how}")
    hot = hot_keys(facts, [key], hot_rows).select(
        F.col(key).alias("_hot_key"),
        F.ceil(F.col("key_rows") / hot_rows).cast("int").alias("_salts"),
    )
    spread = facts.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*facts.columns), F.col("_salts")).cast("int")
        ),
    ).drop("_hot_key", "_salts")
    repeated = entities.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_hot_key", "_salts")
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")


def join_entities_to_facts(
    entities: DataFrame, facts: DataFrame, key: str, hot_rows: int | None = None
) -> DataFrame:
    """Inner join entity x fact that keeps both keys, the entity's as ``<key>_left``.

    Entities without facts have no row in the result.
    """
    left = f"{key}_left"
    renamed = entities.withColumnRenamed(key, left)
    if hot_rows is None:
        return renamed.join(facts, F.col(left) == F.col(key), "inner")
    keyed = renamed.withColumn(key, F.col(left))
    joined = salted_join(facts, keyed, key, "inner", hot_rows)
    return joined.select(*renamed.columns, *facts.columns)


def label_facts(
    facts: DataFrame, labels: DataFrame, key: str, how: str = "inner", hot_rows: int | None = None
) -> DataFrame:
    """Facts with the label columns of their entity; ``how='left'`` keeps unlabelled facts."""
    if hot_rows is None:
        return facts.join(labels, key, how)
    return salted_join(facts, labels, key, how, hot_rows)


def attach_features(entities: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join entity -> one feature row; entities without facts keep null features."""
    return entities.join(features, key, "left")


def lookup_index(
    df: DataFrame, column: str, factor_map: DataFrame, output: str, unknown: Column | None = None
) -> DataFrame:
    """Replace a level by its index from a (level, idx) table.

    Levels that the map lacks, nulls included, get ``unknown``: by default the size of the map.
    """
    if unknown is None:
        unknown = factor_map.agg(F.count("*").cast("double")).scalar()
    renamed = factor_map.select(F.col("level").alias("_level"), F.col("idx").alias("_idx"))
    joined = df.join(renamed, F.col(column) == F.col("_level"), "left")
    return joined.withColumn(output, F.coalesce("_idx", unknown)).drop("_level", "_idx")


def members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


def non_members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``keys``: the complement of ``members``."""
    return df.join(keys.select(key), key, "left_anti")
