"""The auction domain over the star-schema tables: ``events`` are bids, ``customer`` the bidders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actorlens.functions.expressions import epoch_micros
from actorlens.operators.sampling import stratified_split, train_part

MICROS = 1_000_000
DAY = 86_400 * MICROS
# Gaps of a day and more are breaks in the log, not reactions.
GAP_CUTOFF = DAY
BUCKET_WIDTH = 6 * 3_600 * MICROS
# Spans of time whose ticks are read again when a late bid falls into them.
FEATURE_BLOCK = 7 * DAY

# Columns that identify rows or entities and never enter a feature vector.
DROPPED = [
    "bid_id", "bidder_id", "bidder_id_left", "auction", "ip", "payment_account", "address",
]
CATEGORICAL = ["country", "device", "merchandise", "url"]
DISTINCT_FEATURES = {"ips": "ip", "auctions": "auction"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    event, user = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        event.alias("bid_id"),
        user.alias("bidder_id"),
        k.alias("auction"),
        F.col("event_type").alias("merchandise"),
        F.concat(F.lit("d"), event % 37).alias("device"),
        epoch_micros(F.col("ts")).alias("time"),
        F.concat(F.lit("c"), event % 12).alias("country"),
        F.concat(F.lit("i"), user * 8 + event % (1 + user % 7)).alias("ip"),
        F.concat(F.lit("u"), k).alias("url"),
    )


def bidders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("bidder_id"),
        F.col("c_mktsegment").alias("payment_account"),
        F.col("c_name").alias("address"),
        (F.col("c_acctbal") < 0).cast("int").alias("outcome"),
    )


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified 80% of the bidders that exploration looks at."""
    return train_part(stratified_split(bidders(spark, sf_dir), "bidder_id", "outcome"))


def documents_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second fact table with labels of its own: (doc_id, lang, source, n_chars, toxic, quality)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")
