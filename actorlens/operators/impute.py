"""Standardise numeric columns and fill their gaps from the nearest complete rows.

Fitted on one table and applied to others, so that a validation set is scaled and filled with
what the training set knows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actorlens.functions.columns import continuous_columns, is_missing
from actorlens.operators.joins import join_on
from actorlens.operators.neighbours import LEAF_ROWS, build_tree, nearest_in_tree, rooted_points, roots
from actorlens.sources.storage import materialise

#: Digits of the z-scores that distances are taken of: the last bits of a mean depend on the order
#: of its sum, and equal distances have to stay equal from run to run.
RANKED_DIGITS = 9
_RANKED = "_at_"


def _any_null(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])


def _nan_as_null(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~is_missing(c, df.schema[c].dataType), F.col(c)) for c in names})


def _ranked(names: list[str]) -> list[Column]:
    return [F.round(c, RANKED_DIGITS).alias(_RANKED + c) for c in names]


@dataclass
class KnnImputer:
    """Means, sample sds and complete rows of the fitted table."""

    key: str
    columns: list[str]
    means: dict[str, float]
    sds: dict[str, float]
    donors: DataFrame
    k: int = 5
    leaf_rows: int = LEAF_ROWS
    #: Search tree over the donors and its roots; all tables whose gaps it covers share it.
    tree: tuple | None = None

    def standardise(self, df: DataFrame) -> DataFrame:
        """Z-scores behind the untouched columns; nulls and NaN are null."""
        rest = [c for c in df.columns if c not in self.columns]
        scaled = [((F.col(c).cast("double") - self.means[c]) / self.sds[c]).alias(c) for c in self.columns]
        return _nan_as_null(df, self.columns).select(*rest, *scaled)

    def transform(self, df: DataFrame) -> DataFrame:
        """Standardise, then replace each null by the mean of the k nearest complete rows.

        Distances run over the columns a row does have. A row without any value has no neighbours,
        and without any complete row there are none for anyone: both are errors. Every row of the
        table is in the result.
        """
        scaled = materialise(self.standardise(df))
        rows = scaled.filter(_any_null(self.columns))
        nothing = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in self.columns])
        gaps = rows.agg(F.count("*").alias("rows"), F.count_if(nothing).alias("empty")).first()
        if gaps["rows"] and self.donors.isEmpty():
            raise ValueError("no complete row to fill the gaps of others from")
        if gaps["empty"]:
            raise ValueError("a row has no value in any column to impute")
        complete = scaled.filter(~_any_null(self.columns))
        return complete.unionByName(self._fill(rows).select(scaled.columns)) if gaps["rows"] else complete

    def _donor_tree(self, needed: list[str]) -> tuple:
        """Roots, boxes and donors of the tree, built when it lacks a root that rows need."""
        known = self.tree[0] if self.tree else []
        if not self.tree or not {*needed} <= {*known}:
            patterns = sorted({*known, *needed})
            dims = [_RANKED + c for c in self.columns]
            donors = self.donors.select(F.col(self.key).alias("_donor"), *_ranked(self.columns), *self.columns)
            points = rooted_points(donors, dims, "_donor", self.k, patterns)
            self.tree = (patterns, *build_tree(points, dims, self.leaf_rows))
        return self.tree

    def _fill(self, rows: DataFrame) -> DataFrame:
        dims = [_RANKED + c for c in self.columns]
        placed = rows.select("*", *_ranked(self.columns))
        found = nearest_in_tree(placed, *self._donor_tree(roots(placed, dims)), dims, "_donor", self.k)
        values = found.groupBy(*dims).agg(*[F.avg(c).alias(f"_near_{c}") for c in self.columns])
        joined = join_on(placed, values, dims, "left")
        return joined.withColumns({c: F.coalesce(c, f"_near_{c}") for c in self.columns})


def fit_imputer(
    df: DataFrame, key: str, columns: list[str] | None = None, k: int = 5, leaf_rows: int = LEAF_ROWS
) -> KnnImputer:
    """Fit on the columns named, or on every continuous column but the key."""
    columns = columns or [c for c in continuous_columns(df) if c != key]
    df = _nan_as_null(df, columns)
    row = df.agg(
        *[F.avg(c).cast("double").alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns],
    ).first()
    means = {c: row[f"mean_{c}"] for c in columns}
    # A column without spread is centred only.
    sds = {c: row[f"sd_{c}"] or 1.0 for c in columns}
    empty = [c for c in columns if means[c] is None]
    if empty:
        raise ValueError(f"columns without any value cannot be fitted: {empty}")
    imputer = KnnImputer(key, columns, means, sds, df, k, leaf_rows)
    complete = imputer.standardise(df.select(key, *columns)).filter(~_any_null(columns))
    imputer.donors = materialise(complete)
    return imputer
