"""Feature preparation: from raw bids and bidders to scaled, split and folded bidder tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actorlens.functions.columns import drop_null_rows, fill_constant, strict_cast
from actorlens.operators import frequency
from actorlens.operators.gaps import entity_features
from actorlens.operators.impute import KnnImputer, fit_imputer
from actorlens.operators.joins import attach_features
from actorlens.plans.bindings import DISTINCT_FEATURES, GAP_CUTOFF

COUNTS = ["ips", "bids", "auctions"]
INTERVALS = ["avg_bid_interval", "sd_bid_interval"]
NUMERIC = [*COUNTS, *INTERVALS]


def per_bidder(bids: DataFrame, cutoff: int = GAP_CUTOFF, scale: float = 1.0) -> DataFrame:
    """Behaviour of every bidder over all its bids."""
    return entity_features(bids, "bidder_id", "time", DISTINCT_FEATURES, cutoff, scale)


def bidder_table(bidders: DataFrame, features: DataFrame) -> DataFrame:
    """Bidders with their features, the counts as doubles and the outcome, if any, as int."""
    joined = attach_features(bidders, features, "bidder_id")
    types = {c: "double" for c in COUNTS}
    if "outcome" in joined.columns:
        types["outcome"] = "int"
    return strict_cast(joined, types)


def labelled_bidders(bidders: DataFrame, features: DataFrame) -> DataFrame:
    """Bidders that placed bids: the ones a model can learn from."""
    return drop_null_rows(bidder_table(bidders, features), "bids")


def bidders_to_score(bidders: DataFrame, features: DataFrame) -> DataFrame:
    """All bidders; those without bids count as one bid, one ip and one auction."""
    return fill_constant(bidder_table(bidders, features), COUNTS, 1.0)


def imputed_pair(train: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, KnnImputer]:
    """Both tables scaled and filled by what the first one knows."""
    imputer = fit_imputer(train, "bidder_id", NUMERIC)
    return imputer.transform(train), imputer.transform(other), imputer


def factor_maps(bids: DataFrame, columns: list[str], frequent: dict[str, int] | None = None) -> DataFrame:
    """(column, level, idx) of categorical columns: all levels, or those with a number of rows."""
    counts = frequency.level_counts_by_column(bids, columns)
    for column, threshold in (frequent or {}).items():
        counts = counts.filter((F.col("column") != column) | (F.col("count") >= threshold))
    return frequency.factor_maps(counts)
