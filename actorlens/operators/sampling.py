"""Reproducible splits, folds and oversampling, stratified by label."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actorlens.operators.ordering import digest_rank, first_by_digest


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8) -> DataFrame:
    """Add ``in_train``: true for the first floor(share * n) rows of each label by MD5 of the key.

    The split depends on keys and labels only, not on partitioning or row order.
    """
    return first_by_digest(df, [label], key, share, "in_train")


def train_part(split: DataFrame) -> DataFrame:
    return split.filter("in_train").drop("in_train")


def test_part(split: DataFrame) -> DataFrame:
    """The complement of ``train_part``."""
    return split.filter(~F.col("in_train")).drop("in_train")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 10) -> DataFrame:
    """Add ``fold`` 0..k-1; a label's fold sizes differ by at most one."""
    ranked = digest_rank(df, [label], key)
    fold = F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")
    return ranked.withColumn("fold", fold).drop("rank", "group_rows")


def plain_folds(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Add ``fold`` 0..k-1 without regard to a label."""
    return stratified_folds(df.withColumn("_all", F.lit(0)), key, "_all", k).drop("_all")


def fold_pair(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation part of one fold."""
    train, valid = folds.filter(F.col("fold") != fold), folds.filter(F.col("fold") == fold)
    return train.drop("fold"), valid.drop("fold")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _poisson_thresholds(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, ... draws, up to a negligible rest."""
    term = total = math.exp(-rate)
    out = [total]
    while 1 - total > 1e-12 and len(out) < 100:
        term *= rate / len(out)
        total += term
        out.append(total)
    return out


def oversample(
    df: DataFrame,
    label: str,
    value: float,
    times: int,
    accept_rate: float = 0.9,
    seed: int = 10,
    include_original: bool = False,
    key: list[str] | None = None,
) -> DataFrame:
    """``times`` draws with replacement of the rows with one label, each with its own seed.

    How often a row is drawn follows from a hash of its ``key`` columns (all by default), so draws do
    not depend on partitions. Rows with equal keys are drawn alike.
    """
    minority = df.filter(F.col(label) == value)

    def draw(number: int) -> DataFrame:
        hashed = F.xxhash64(F.lit(seed + number), *(key or df.columns))
        uniform = F.pmod(hashed, F.lit(1 << 53)) / float(1 << 53)
        copies = F.size(F.filter(F.array(*map(F.lit, _poisson_thresholds(accept_rate))), lambda p: p < uniform))
        repeated = F.explode(F.array_repeat(F.lit(1), copies))
        return minority.withColumn("_draw", repeated).drop("_draw")

    draws = [draw(i) for i in range(times)]
    if include_original:
        draws = [df, *draws]
    return union_all(draws) if draws else minority.limit(0)


def replicate(df: DataFrame, label: str, value: float, times: int, include_original: bool = True) -> DataFrame:
    """Each row of one label ``times`` more, numbered by ``draw``: oversampling without chance."""
    copies = F.when(F.col(label) == value, F.lit(times)).otherwise(F.lit(0))
    first = 0 if include_original else 1
    draws = F.filter(F.sequence(F.lit(0), copies), lambda i: i >= first)
    return df.withColumn("draw", F.explode(draws))
