"""Named queries over the star-schema tables, each with the SQL that gives the same rows.

Every query reads its whole tables. A query without SQL trains a model; the tests check those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from actorlens.functions import trees
from actorlens.functions.columns import continuous_columns, sanitise_names
from actorlens.functions.expressions import time_bucket
from actorlens.operators import (
    copartitioned,
    encoding,
    frequency,
    gaps,
    impute,
    joins,
    maintained,
    metrics,
    profiles,
    quantiles,
    sampling,
    sets,
    sketches,
)
from actorlens.plans import bindings as b
from actorlens.plans import features, models
from actorlens.sources import delimited, factor_maps, rejects, schema_files
from actorlens.sources.storage import empty_table, load_model, materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Parameters that fit the row counts of the generated tables.
FREQUENT = 100
MIN_LEVEL_ROWS = 10
CV_FOLDS = 5
SECONDS = float(b.MICROS)

_BIDS = """
bids AS (
  SELECT event_id AS bid_id, user_id AS bidder_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS auction,
         event_type AS merchandise, 'd' || (event_id % 37) AS device, epoch_us(ts) AS time,
         'c' || (event_id % 12) AS country, 'i' || (user_id * 8 + event_id % (1 + user_id % 7)) AS ip,
         'u' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS url
  FROM events)"""
_BIDDERS = """
bidders AS (
  SELECT c_custkey AS bidder_id, c_mktsegment AS payment_account, c_name AS address,
         CAST(c_acctbal < 0 AS INTEGER) AS outcome
  FROM customer)"""
_SPLIT = """
split AS (
  SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY md5(CAST(bidder_id AS VARCHAR)))
              <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY outcome)) AS in_train
  FROM bidders)"""
_TRAINING = _SPLIT + """,
training AS (SELECT bidder_id, payment_account, address, outcome FROM split WHERE in_train)"""
_DI = _TRAINING + """,
di AS (SELECT bids.*, payment_account, address, outcome FROM bids JOIN training USING (bidder_id))"""


def _with(*parts: str) -> str:
    return "WITH" + ",".join(parts)


ALL = _with(_BIDS, _BIDDERS, _DI)


def _gap_sql(keys: str) -> str:
    """Gap statistics in seconds by keys, as CTE ``stats``."""
    return f"""
gaps AS (
  SELECT {keys}, time - lag(time) OVER (PARTITION BY {keys} ORDER BY time, bid_id) AS gap
  FROM bids),
kept AS (SELECT *, CASE WHEN gap < {b.GAP_CUTOFF} THEN gap END AS g FROM gaps),
stats AS (
  SELECT {keys}, count(g) AS gaps, CAST(sum(g) AS DOUBLE) / nullif(count(g), 0) / 1e6 AS avg_gap,
         stddev_samp(g / 1e6) AS sd_gap
  FROM kept GROUP BY {keys})"""


def _feature_sql(entity: str) -> str:
    """Entity features as CTE ``features``; intervals are logs of seconds."""
    return _gap_sql(entity) + f""",
features AS (
  SELECT {entity}, ips, auctions, bids, ln(1 + avg_gap) AS avg_bid_interval,
         ln(1 + sd_gap) AS sd_bid_interval
  FROM (SELECT {entity}, count(DISTINCT ip) AS ips, count(DISTINCT auction) AS auctions,
               count(*) AS bids
        FROM bids GROUP BY {entity}) JOIN stats USING ({entity}))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _labelled_bids(spark: SparkSession, d: str) -> DataFrame:
    labels = b.training(spark, d)
    return joins.label_facts(b.bids(spark, d), labels, "bidder_id")


def _counts_by_label(spark: SparkSession, d: str, *keys: str | Column, facts: DataFrame | None = None) -> DataFrame:
    """Rows by keys and outcome. Bids shrink to one row per bidder and keys before the labels join."""
    facts = b.bids(spark, d) if facts is None else facts
    counts = profiles.count_by(facts, "bidder_id", *keys)
    labels = b.training(spark, d).select("bidder_id", "outcome")
    names = [c for c in counts.columns if c not in ("bidder_id", "count")]
    return profiles.roll_up(counts.join(labels, "bidder_id"), "outcome", *names)


def _rule(facts: DataFrame) -> DataFrame:
    """A fixed rule in place of a model, so that scores and metrics can be checked by SQL."""
    return facts.withColumn("pred", (F.col("auction") < 20).cast("double"))


def _rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the training bidders. Bids shrink to one row per bidder before the labels join."""
    scores = metrics.entity_scores(_rule(b.bids(spark, d)), "bidder_id", label=None)
    return scores.join(b.training(spark, d).select("bidder_id", "outcome"), "bidder_id")


# ---------------------------------------------------------------- tables and joins


@query(
    "bids_view",
    _with(_BIDS) + " SELECT * FROM bids",
)
def bids_view(spark, d):
    return b.bids(spark, d)


@query(
    "inner_join_bidders",
    _with(_BIDS, _BIDDERS)
    + """ SELECT x.bidder_id AS bidder_id_left, payment_account, address, outcome, bids.*
          FROM bidders x JOIN bids ON x.bidder_id = bids.bidder_id""",
)
def inner_join_bidders(spark, d):
    return joins.join_entities_to_facts(b.bidders(spark, d), b.bids(spark, d), "bidder_id")


@query(
    "salted_join_bidders",
    _with(_BIDS, _BIDDERS)
    + """ SELECT x.bidder_id AS bidder_id_left, payment_account, address, outcome, bids.*
          FROM bidders x JOIN bids ON x.bidder_id = bids.bidder_id""",
)
def salted_join_bidders(spark, d):
    return joins.join_entities_to_facts(
        b.bidders(spark, d), b.bids(spark, d), "bidder_id", hot_rows=60
    )


@query("inner_join_training", ALL + " SELECT * FROM di")
def inner_join_training(spark, d):
    return _labelled_bids(spark, d)


@query(
    "left_join_labels",
    _with(_BIDS, _BIDDERS, _TRAINING)
    + """ SELECT outcome, count(*) AS "rows" FROM bids LEFT JOIN training USING (bidder_id)
          GROUP BY outcome""",
)
def left_join_labels(spark, d):
    labels = b.training(spark, d).select("bidder_id", "outcome")
    counts = profiles.count_by(b.bids(spark, d), "bidder_id", name="rows")
    return profiles.roll_up(joins.label_facts(counts, labels, "bidder_id", "left"), "outcome", name="rows")


@query(
    "left_join_features",
    _with(_BIDS, _BIDDERS, _feature_sql("bidder_id"))
    + """ SELECT x.*, CAST(coalesce(ips, 1) AS DOUBLE) AS ips,
                 CAST(coalesce(auctions, 1) AS DOUBLE) AS auctions,
                 CAST(coalesce(bids, 1) AS DOUBLE) AS bids,
                 round(avg_bid_interval, 6) AS avg_bid_interval,
                 round(sd_bid_interval, 6) AS sd_bid_interval
          FROM bidders x LEFT JOIN features USING (bidder_id)""",
)
def left_join_features(spark, d):
    per_bidder = features.per_bidder(b.bids(spark, d), scale=SECONDS)
    table = features.bidders_to_score(b.bidders(spark, d), per_bidder)
    return rounded(table, *features.INTERVALS)


@query(
    "bucketed_bidder_activity",
    _with(_BIDS, _BIDDERS)
    + """, activity AS (SELECT bidder_id, count(*) AS bids, min(time) AS first_time, max(time) AS last_time
                       FROM bids GROUP BY bidder_id)
          SELECT x.*, bids, first_time, last_time FROM bidders x LEFT JOIN activity USING (bidder_id)""",
)
def bucketed_bidder_activity(spark, d):
    """Bidders with what their bids amount to, from tables in equal buckets that are not moved again."""
    stored = copartitioned.CoPartitioned.build(b.bids(spark, d), b.bidders(spark, d), "bidder_id", buckets=8)
    return stored.attach(
        [F.count("*").alias("bids"), F.min("time").alias("first_time"), F.max("time").alias("last_time")]
    )


@query(
    "bucketed_join_bidders",
    _with(_BIDS, _BIDDERS) + " SELECT * FROM bids JOIN bidders USING (bidder_id)",
)
def bucketed_join_bidders(spark, d):
    return copartitioned.CoPartitioned.build(b.bids(spark, d), b.bidders(spark, d), "bidder_id", buckets=8).join()


@query(
    "active_bidders",
    _with(_BIDS, _BIDDERS, _feature_sql("bidder_id"))
    + """ SELECT x.*, CAST(ips AS DOUBLE) AS ips, CAST(auctions AS DOUBLE) AS auctions,
                 CAST(bids AS DOUBLE) AS bids, round(avg_bid_interval, 6) AS avg_bid_interval,
                 round(sd_bid_interval, 6) AS sd_bid_interval
          FROM bidders x LEFT JOIN features USING (bidder_id) WHERE bids IS NOT NULL""",
)
def active_bidders(spark, d):
    per_bidder = features.per_bidder(b.bids(spark, d), scale=SECONDS)
    return rounded(features.labelled_bidders(b.bidders(spark, d), per_bidder), *features.INTERVALS)


@query(
    "label_lookup_join",
    _with(_BIDS)
    + f""", known AS (
            SELECT url AS level, row_number() OVER (ORDER BY url) - 1 AS idx
            FROM bids GROUP BY url HAVING count(*) >= {FREQUENT})
          SELECT bid_id, url,
                 CAST(coalesce(idx, (SELECT count(*) FROM known)) AS DOUBLE) AS url_idx
          FROM bids LEFT JOIN known ON url = level""",
)
def label_lookup_join(spark, d):
    facts = b.bids(spark, d).select("bid_id", "url")
    known = frequency.frequent_levels(frequency.level_counts(facts, "url"), FREQUENT)
    return joins.lookup_index(facts, "url", frequency.factor_map(known), "url_idx")


@query(
    "anti_semi_split",
    _with(_BIDS, _BIDDERS, _TRAINING)
    + """ SELECT 'train' AS part, bid_id, bidder_id FROM bids
          WHERE bidder_id IN (SELECT bidder_id FROM training)
          UNION ALL
          SELECT 'rest' AS part, bid_id, bidder_id FROM bids
          WHERE bidder_id NOT IN (SELECT bidder_id FROM training)""",
)
def anti_semi_split(spark, d):
    facts, keys = b.bids(spark, d).select("bid_id", "bidder_id"), b.training(spark, d)
    return sampling.union_all(
        [
            joins.members(facts, keys, "bidder_id").withColumn("part", F.lit("train")),
            joins.non_members(facts, keys, "bidder_id").withColumn("part", F.lit("rest")),
        ]
    )


# ---------------------------------------------------------------- counts and profiles


@query(
    "count_by_bidder_outcome",
    ALL + " SELECT bidder_id, outcome, count(*) AS num_bids FROM di GROUP BY bidder_id, outcome",
)
def count_by_bidder_outcome(spark, d):
    counts = profiles.count_by(b.bids(spark, d), "bidder_id", name="num_bids")
    return counts.join(b.training(spark, d).select("bidder_id", "outcome"), "bidder_id")


_BUCKETS = ALL + f""",
hist AS (
  SELECT outcome, country, (time - (SELECT min(time) FROM bids)) // {b.BUCKET_WIDTH} AS bucket,
         count(*) AS "count"
  FROM di GROUP BY ALL)"""


def _bucket_counts(spark, d):
    first = b.bids(spark, d).agg(F.min("time")).scalar()
    bucket = time_bucket(F.col("time"), first, b.BUCKET_WIDTH).alias("bucket")
    return _counts_by_label(spark, d, "country", bucket)


@query("count_by_country_bucket", _BUCKETS + " SELECT * FROM hist")
def count_by_country_bucket(spark, d):
    return _bucket_counts(spark, d)


@query(
    "rebucket_rollup",
    _BUCKETS
    + """ SELECT 'all' AS part, outcome, bucket, CAST(sum("count") AS BIGINT) AS "count"
          FROM hist GROUP BY outcome, bucket
          UNION ALL
          SELECT 'first 50', outcome, bucket, CAST(sum("count") AS BIGINT)
          FROM hist WHERE bucket < 50 GROUP BY outcome, bucket
          UNION ALL
          SELECT '50 to 99', outcome, bucket, CAST(sum("count") AS BIGINT)
          FROM hist WHERE bucket >= 50 AND bucket < 100 GROUP BY outcome, bucket
          UNION ALL
          SELECT 'country c1', outcome, bucket, CAST(sum("count") AS BIGINT)
          FROM hist WHERE country = 'c1' GROUP BY outcome, bucket""",
)
def rebucket_rollup(spark, d):
    # Each count falls into up to three parts, so one pass serves all of them.
    bucket, country = F.col("bucket"), F.col("country")
    parts = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(bucket < 50, F.lit("first 50")),
            F.when((bucket >= 50) & (bucket < 100), F.lit("50 to 99")),
            F.when(country == "c1", F.lit("country c1")),
        )
    )
    marked = _bucket_counts(spark, d).withColumn("part", F.explode(parts))
    return profiles.roll_up(marked, "part", "outcome", "bucket")


@query(
    "pivot_country_label",
    ALL
    + """ SELECT * FROM (
            SELECT country, count(*) FILTER (outcome = 0) AS human,
                   count(*) FILTER (outcome = 1) AS bot FROM di GROUP BY country)
          WHERE bot < 20000""",
)
def pivot_country_label(spark, d):
    counts = _counts_by_label(spark, d, "country")
    wide = profiles.pivot_counts(counts, "country", "outcome", {0: "human", 1: "bot"})
    return profiles.below(wide, "bot", 20_000)


def _profile_sql(attribute: str, condition: str = "true") -> str:
    return (
        ALL
        + f""" SELECT * FROM (
            SELECT {attribute}, count(*) FILTER (outcome = 0) AS humans,
                   count(*) FILTER (outcome = 1) AS bots,
                   count(DISTINCT bidder_id) FILTER (outcome = 0) AS distinct_humans,
                   count(DISTINCT bidder_id) FILTER (outcome = 1) AS distinct_bots
            FROM di GROUP BY {attribute}) WHERE {condition}"""
    )


def _profile(spark, d, attribute):
    return profiles.label_profile(
        b.bids(spark, d), b.training(spark, d), attribute, "bidder_id", "outcome"
    )


@query("profile_by_url", _profile_sql("url", "humans < 200000 AND distinct_humans < 1000"))
def profile_by_url(spark, d):
    few_rows = profiles.below(_profile(spark, d, "url"), "humans", 200_000)
    return profiles.below(few_rows, "distinct_humans", 1_000)


@query("profile_by_merchandise", _profile_sql("merchandise"))
def profile_by_merchandise(spark, d):
    return _profile(spark, d, "merchandise")


@query("profile_by_device", _profile_sql("device"))
def profile_by_device(spark, d):
    return _profile(spark, d, "device")


@query(
    "label_counts_by_merchandise",
    ALL
    + """ SELECT merchandise, count(*) FILTER (outcome = 0) AS humans,
                 count(*) FILTER (outcome = 1) AS bots FROM di GROUP BY merchandise""",
)
def label_counts_by_merchandise(spark, d):
    counts = _counts_by_label(spark, d, "merchandise")
    return profiles.pivot_counts(counts, "merchandise", "outcome", {0: "humans", 1: "bots"})


_PROFILE_COLUMNS = {
    "ips": "ip",
    "auctions": "auction",
    "categories": "merchandise",
    "countries": "country",
    "urls": "url",
}
_BIDDER_PROFILE = ALL + """,
num_ip AS (
  SELECT bidder_id, outcome, count(DISTINCT ip) AS ips, count(*) AS bids,
         count(DISTINCT auction) AS auctions, count(DISTINCT merchandise) AS categories,
         count(DISTINCT country) AS countries, count(DISTINCT url) AS urls
  FROM di GROUP BY bidder_id, outcome)"""


def _bidder_profile(spark, d):
    counts = profiles.distinct_profile(b.bids(spark, d), "bidder_id", _PROFILE_COLUMNS)
    return counts.join(b.training(spark, d).select("bidder_id", "outcome"), "bidder_id")


@query("bidder_distinct_profile", _BIDDER_PROFILE + " SELECT * FROM num_ip")
def bidder_distinct_profile(spark, d):
    return _bidder_profile(spark, d)


@query(
    "bidder_auctions",
    ALL
    + """ SELECT bidder_id, outcome, count(DISTINCT auction) AS auctions
          FROM di GROUP BY bidder_id, outcome""",
)
def bidder_auctions(spark, d):
    pairs = b.bids(spark, d).select("bidder_id", "auction").distinct()
    counts = profiles.count_by(pairs, "bidder_id", name="auctions")
    return counts.join(b.training(spark, d).select("bidder_id", "outcome"), "bidder_id")


@query(
    "bidder_sets_by_country",
    _with(_BIDS) + """ SELECT country, count(DISTINCT bidder_id) AS bidders,
                              count(DISTINCT bidder_id) FILTER (auction < 50) AS early_bidders FROM bids GROUP BY country""",
)
def bidder_sets_by_country(spark, d):
    """Exact sets of bidders, made by country and auction, rolled up as bitmaps."""
    facts = b.bids(spark, d)
    everyone = materialise(frequency.factor_map(facts.select(F.col("bidder_id").cast("string").alias("level")).distinct()))
    stored = materialise(sets.level_sets(facts, ["country", "auction"], "bidder_id", everyone))
    by_country = sets.merge(stored, ["country"]).groupBy("country").agg(sets.set_size().alias("bidders"))
    early = sets.merge(stored.filter("auction < 50"), ["country"]).groupBy("country").agg(sets.set_size().alias("early_bidders"))
    return by_country.join(early, "country", "left").fillna(0, ["early_bidders"])


@query(
    "sketches_by_merchandise",
    _with(_BIDS) + """ SELECT merchandise, count(*) AS "rows", count(DISTINCT ip) AS ips, count(DISTINCT bidder_id) AS bidders,
                              true AS ips_near, true AS bidders_near, true AS median_near, true AS p90_near
                       FROM bids GROUP BY merchandise""",
)
def sketches_by_merchandise(spark, d):
    """Sketches by day, rolled up, beside the exact counts and ranks they have to come near."""
    facts = b.bids(spark, d)
    distinct, shares = {"ips": "ip", "bidders": "bidder_id"}, {"times": {"median": 0.5, "p90": 0.9}}
    daily = facts.withColumn("day", F.floor(F.col("time") / b.DAY))
    table = sketches.sketch_table(daily, ["day", "merchandise"], distinct, {"times": "time"})
    rolled = sketches.roll_up(table, ["merchandise"], list(distinct), list(shares))
    told = materialise(sketches.estimates(rolled, ["merchandise"], list(distinct), shares))
    exact = profiles.distinct_profile(facts, "merchandise", distinct, "rows")
    places = facts.join(told.select("merchandise", "median", "p90"), "merchandise").groupBy("merchandise").agg(
        *[(F.count_if(F.col("time") <= F.col(name)) / F.count("*")).alias(f"_{name}") for name in shares["times"]]
    )
    near = [(F.abs(F.col(f"_about_{o}") / F.col(o) - 1) <= 0.02).alias(f"{o}_near") for o in distinct]
    near += [(F.abs(F.col(f"_{name}") - share) <= 0.02).alias(f"{name}_near") for name, share in shares["times"].items()]
    about = told.select("merchandise", *[F.col(o).alias(f"_about_{o}") for o in distinct])
    return exact.join(about, "merchandise").join(places, "merchandise").select("merchandise", "rows", *distinct, *near)


@query(
    "numeric_summary",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg(CAST({c} AS DOUBLE)), 4) AS mean FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    + ")",
)
def numeric_summary(spark, d):
    """Count and mean of every column that its type says is continuous."""
    table = b.table(spark, d, "lineitem")
    names = continuous_columns(table)
    long = quantiles.unpivot_metrics(table.select(*names).withColumn("all", F.lit(0)), ["all"], names)
    means = long.groupBy(F.col("metric").alias("column")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return rounded(means, "mean", digits=4)


@query(
    "document_profile",
    """WITH docs AS (SELECT source, lang, toxic FROM documents JOIN labels USING (doc_id)),
       p AS (SELECT lang, count(*) FILTER (toxic = 0) AS humans, count(*) FILTER (toxic = 1) AS bots,
                    count(DISTINCT source) FILTER (toxic = 0) AS distinct_humans,
                    count(DISTINCT source) FILTER (toxic = 1) AS distinct_bots
             FROM docs GROUP BY lang)
       SELECT * FROM p""",
)
def document_profile(spark, d):
    # Here the label belongs to the row, not to the entity.
    docs = b.documents_with_labels(spark, d).filter(F.col("toxic").isNotNull())
    pairs = docs.groupBy("lang", "source").agg(
        F.count_if(F.col("toxic") == 0).alias("h"), F.count_if(F.col("toxic") == 1).alias("t")
    )
    return pairs.groupBy("lang").agg(
        F.sum("h").alias("humans"),
        F.sum("t").alias("bots"),
        F.count_if(F.col("h") > 0).alias("distinct_humans"),
        F.count_if(F.col("t") > 0).alias("distinct_bots"),
    )


# ---------------------------------------------------------------- gaps


_STATS = "gaps, round(avg_gap, 6) AS avg_gap, round(sd_gap, 6) AS sd_gap"


@query(
    "gaps_by_bidder",
    _with(_BIDS, _BIDDERS, _TRAINING, _gap_sql("bidder_id"))
    + f" SELECT bidder_id, outcome, {_STATS} FROM stats JOIN training USING (bidder_id)",
)
def gaps_by_bidder(spark, d):
    stats = gaps.gap_stats(b.bids(spark, d), ["bidder_id"], "time", b.GAP_CUTOFF, SECONDS)
    joined = stats.join(b.training(spark, d).select("bidder_id", "outcome"), "bidder_id")
    return rounded(joined, "avg_gap", "sd_gap")


@query(
    "gaps_by_bidder_segmented",
    _with(_BIDS, _gap_sql("bidder_id")) + f" SELECT bidder_id, {_STATS} FROM stats",
)
def gaps_by_bidder_segmented(spark, d):
    # The same statistics with every bidder treated as a hot key.
    stats = gaps.gap_stats(
        b.bids(spark, d), ["bidder_id"], "time", b.GAP_CUTOFF, SECONDS, segment_rows=10
    )
    return rounded(stats, "avg_gap", "sd_gap")


@query(
    "gaps_by_bidder_auction",
    _with(_BIDS, _BIDDERS, _TRAINING, _gap_sql("bidder_id, auction, merchandise"))
    + f""" SELECT bidder_id, auction, merchandise, outcome, {_STATS}
           FROM stats JOIN training USING (bidder_id)""",
)
def gaps_by_bidder_auction(spark, d):
    keys = ["bidder_id", "auction", "merchandise"]
    stats = gaps.gap_stats(b.bids(spark, d), keys, "time", b.GAP_CUTOFF, SECONDS)
    joined = stats.join(b.training(spark, d).select("bidder_id", "outcome"), "bidder_id")
    return rounded(joined, "avg_gap", "sd_gap")


@query(
    "auction_responder_gaps",
    _with(_BIDS, _BIDDERS, _TRAINING)
    + f""", gaps AS (
            SELECT auction, outcome,
                   time - lag(time) OVER (PARTITION BY auction ORDER BY time, bid_id) AS gap
            FROM bids LEFT JOIN training USING (bidder_id)),
          kept AS (SELECT auction, CASE WHEN outcome = 0 AND gap < {b.GAP_CUTOFF} THEN gap END AS h,
                          CASE WHEN outcome = 1 AND gap < {b.GAP_CUTOFF} THEN gap END AS r FROM gaps)
          SELECT auction, count(h) AS human_gaps,
                 round(CAST(sum(h) AS DOUBLE) / nullif(count(h), 0) / 1e6, 6) AS human_avg,
                 round(stddev_samp(h / 1e6), 6) AS human_sd,
                 count(r) AS bot_gaps,
                 round(CAST(sum(r) AS DOUBLE) / nullif(count(r), 0) / 1e6, 6) AS bot_avg,
                 round(stddev_samp(r / 1e6), 6) AS bot_sd
          FROM kept GROUP BY auction""",
)
def auction_responder_gaps(spark, d):
    labels = b.training(spark, d).select("bidder_id", "outcome")
    facts = joins.label_facts(b.bids(spark, d), labels, "bidder_id", "left")
    stats = gaps.responder_gap_stats(
        facts, "auction", "time", "bid_id", "outcome", b.GAP_CUTOFF, SECONDS
    )
    return rounded(stats, "human_avg", "human_sd", "bot_avg", "bot_sd")


_FEATURES_OUT = """ SELECT bidder_id, ips, auctions, bids,
  round(avg_bid_interval, 6) AS avg_bid_interval, round(sd_bid_interval, 6) AS sd_bid_interval
  FROM features"""


@query("per_bidder_features", _with(_BIDS, _feature_sql("bidder_id")) + _FEATURES_OUT)
def per_bidder_features(spark, d):
    return rounded(features.per_bidder(b.bids(spark, d), scale=SECONDS), *features.INTERVALS)


@query("features_by_batches", _with(_BIDS, _feature_sql("bidder_id")) + _FEATURES_OUT)
def features_by_batches(spark, d):
    """The same features, kept up to date by three batches whose times interleave."""
    facts = b.bids(spark, d)
    state = maintained.MaintainedFeatures(
        spark, "bidder_id", "time", b.DISTINCT_FEATURES, b.GAP_CUTOFF, width=b.FEATURE_BLOCK
    )
    batch = F.pmod(F.xxhash64("bid_id"), F.lit(3))
    for number in range(3):
        state = state.add(facts.filter(batch == number))
    return rounded(state.features(SECONDS), *features.INTERVALS)


@query("grouped_table_udf", _with(_BIDS, _feature_sql("bidder_id")) + _FEATURES_OUT)
def grouped_table_udf(spark, d):
    import pandas as pd

    cutoff = b.GAP_CUTOFF

    def kept_gaps(ticks: pd.DataFrame) -> pd.DataFrame:
        rows, gap = ticks["rows"].to_numpy(), ticks["gap"].to_numpy(float)
        seconds = gap[gap < cutoff] / 1e6
        return pd.DataFrame(
            {
                "bidder_id": ticks["bidder_id"].iloc[:1],
                "bids": rows.sum(),
                "n": len(seconds) + (rows - 1).sum(),
                "total": seconds.sum(),
                "squares": (seconds * seconds).sum(),
            }
        )

    facts = b.bids(spark, d)
    schema = "bidder_id bigint, bids bigint, n bigint, total double, squares double"
    n, total, squares = (F.sum(c) for c in ("n", "total", "squares"))
    merge = [
        F.sum("bids").alias("bids"),
        F.log1p(total / F.when(n > 0, n)).alias("avg_bid_interval"),
        F.log1p(
            F.sqrt((squares - total * total / F.when(n > 1, n)) / F.when(n > 1, n - 1))
        ).alias("sd_bid_interval"),
    ]
    merged = gaps.apply_to_segments(facts, ["bidder_id"], "time", kept_gaps, schema, merge)
    counts = profiles.distinct_profile(facts, "bidder_id", b.DISTINCT_FEATURES).drop("bids")
    return rounded(merged.join(counts, "bidder_id"), *features.INTERVALS)


# ---------------------------------------------------------------- frequencies


_URL_COUNTS = _BIDS + """,
counts AS (SELECT url AS level, count(*) AS "count" FROM bids GROUP BY url),
cumulative AS (
  SELECT level, "count", row_number() OVER w AS rank, CAST(sum("count") OVER w AS BIGINT) AS cumulative,
         sum("count") OVER w / CAST(sum("count") OVER () AS DOUBLE) AS ratio
  FROM counts
  WINDOW w AS (ORDER BY "count", md5(level) ROWS UNBOUNDED PRECEDING))"""


def _url_counts(spark, d):
    return frequency.level_counts(b.bids(spark, d), "url")


@query(
    "cumulative_frequency",
    _with(_URL_COUNTS)
    + ' SELECT level, "count", rank, cumulative, round(ratio, 9) AS ratio FROM cumulative',
)
def cumulative_frequency(spark, d):
    return rounded(frequency.cumulative_share(_url_counts(spark, d)), "ratio", digits=9)


@query(
    "first_rank_over_share",
    _with(_URL_COUNTS)
    + f""" SELECT 'share' AS rule, min(rank) AS first_rank FROM cumulative WHERE ratio > 0.95
           UNION ALL
           SELECT 'count', min(rank) FROM cumulative WHERE "count" >= {FREQUENT}""",
)
def first_rank_over_share(spark, d):
    counts = _url_counts(spark, d)
    by_share = frequency.first_rank_over(frequency.cumulative_share(counts), 0.95)
    by_count = frequency.first_rank_with_count(counts, FREQUENT)
    return sampling.union_all(
        [
            by_share.withColumn("rule", F.lit("share")),
            by_count.withColumn("rule", F.lit("count")),
        ]
    )


@query(
    "sorted_country_counts",
    ALL
    + """ SELECT country, outcome, count(*) AS "count" FROM di GROUP BY country, outcome
          ORDER BY "count" DESC, country, outcome""",
)
def sorted_country_counts(spark, d):
    counts = _counts_by_label(spark, d, "country")
    return counts.orderBy(F.desc("count"), "country", "outcome")


@query(
    "top_levels",
    _with(_BIDS)
    + """ SELECT ip AS level, count(*) AS "count" FROM bids GROUP BY ip
          ORDER BY "count" DESC, level LIMIT 99""",
)
def top_levels(spark, d):
    return frequency.top_levels(frequency.level_counts(b.bids(spark, d), "ip"), 99)


@query(
    "top_level_vocabulary",
    _with(_BIDS)
    + """ SELECT level, CAST(row_number() OVER (ORDER BY level) - 1 AS DOUBLE) AS idx FROM (
            SELECT ip AS level, count(*) AS n FROM bids GROUP BY ip ORDER BY n DESC, level LIMIT 99)""",
)
def top_level_vocabulary(spark, d):
    counts = frequency.level_counts(b.bids(spark, d), "ip")
    return frequency.factor_map(frequency.top_levels(counts, 99))


@query(
    "heavy_levels",
    _with(_BIDS)
    + """ SELECT ip AS level, count(*) AS "count" FROM bids GROUP BY ip
          ORDER BY "count" DESC, level LIMIT 99""",
)
def heavy_levels(spark, d):
    """The most frequent ips, without counting the rare ones."""
    return frequency.heavy_levels(b.bids(spark, d).select("ip"), "ip", 99)


@query(
    "frequent_levels",
    _with(_BIDS)
    + f""" SELECT url AS level, count(*) AS "count" FROM bids GROUP BY url
           HAVING count(*) >= {FREQUENT}""",
)
def frequent_levels(spark, d):
    return frequency.frequent_levels(_url_counts(spark, d), FREQUENT)


@query(
    "sorted_levels_index",
    _with(_BIDDERS)
    + """ SELECT 'account' AS "column", level, CAST(row_number() OVER (ORDER BY level) - 1 AS DOUBLE) AS idx
          FROM (SELECT DISTINCT payment_account AS level FROM bidders)
          UNION ALL
          SELECT 'address', level, CAST(row_number() OVER (ORDER BY level) - 1 AS DOUBLE)
          FROM (SELECT DISTINCT address AS level FROM bidders)""",
)
def sorted_levels_index(spark, d):
    people = b.bidders(spark, d).withColumnRenamed("payment_account", "account")
    return features.factor_maps(people, ["account", "address"])


def _negentropy_sql(attribute: str) -> str:
    return _profile_sql(attribute).replace(
        "SELECT * FROM (",
        f"""SELECT {attribute}, humans, bots, distinct_humans, distinct_bots,
              CASE WHEN bots = 0 OR humans = 0 THEN 0.0
                   ELSE p * log2(p) + (1 - p) * log2(1 - p) END AS negentropy
            FROM (SELECT *, bots / CAST(humans + bots AS DOUBLE) AS p FROM (""",
        1,
    ).replace("WHERE true", ")")


@query(
    "negentropy_by_attribute",
    f"""SELECT 'ip' AS attribute, ip AS level, humans, bots, distinct_humans, distinct_bots,
               round(negentropy, 9) AS negentropy FROM ({_negentropy_sql("ip")})
        UNION ALL
        SELECT 'device', device, humans, bots, distinct_humans, distinct_bots,
               round(negentropy, 9) FROM ({_negentropy_sql("device")})
        UNION ALL
        SELECT 'url', url, humans, bots, distinct_humans, distinct_bots,
               round(negentropy, 9) FROM ({_negentropy_sql("url")})""",
)
def negentropy_by_attribute(spark, d):
    levels = profiles.label_profiles(
        b.bids(spark, d), b.training(spark, d), ["ip", "device", "url"], "bidder_id", "outcome"
    )
    return rounded(profiles.attribute_informativeness(levels), "negentropy", digits=9)


_INFORMATIVE = f"""informative AS (
  SELECT * FROM ({_negentropy_sql("ip")})
  WHERE humans < bots AND humans + bots > {MIN_LEVEL_ROWS} AND negentropy > -0.7)"""


def _informative_ips(spark, d):
    levels = profiles.attribute_informativeness(_profile(spark, d, "ip"))
    return profiles.informative(levels, MIN_LEVEL_ROWS, -0.7)


@query(
    "informative_levels",
    f"""WITH {_INFORMATIVE}
        SELECT ip, bots, CAST(row_number() OVER (ORDER BY ip) - 1 AS DOUBLE) AS idx FROM informative""",
)
def informative_levels(spark, d):
    selected = _informative_ips(spark, d).select(F.col("ip").alias("level"), "bots")
    return (
        frequency.factor_map(selected).join(selected, "level").withColumnRenamed("level", "ip")
    )


@query(
    "informative_value_counts",
    f"""WITH {_INFORMATIVE}
        SELECT 'distinct_bots' AS what, distinct_bots AS value, count(*) AS levels,
               CAST(sum(bots) AS BIGINT) AS bots
        FROM informative GROUP BY distinct_bots
        UNION ALL
        SELECT 'coverage', NULL, count(*), CAST(coalesce(sum(bots), 0) AS BIGINT) FROM informative""",
)
def informative_value_counts(spark, d):
    selected = _informative_ips(spark, d)
    by_value = selected.groupBy(F.col("distinct_bots").alias("value")).agg(
        F.count("*").alias("levels"), F.sum("bots").alias("bots")
    )
    covered = profiles.coverage(selected).withColumn("value", F.lit(None).cast("bigint"))
    return sampling.union_all(
        [
            by_value.withColumn("what", F.lit("distinct_bots")),
            covered.withColumn("what", F.lit("coverage")),
        ]
    )


_BOX_METRICS = ["ips", "bids", "auctions", "categories", "countries", "urls", "log_bids", "avg_gap", "sd_gap"]


@query(
    "boxplot_by_label",
    _BIDDER_PROFILE
    + ","
    + _gap_sql("bidder_id")
    + f""",
    wide AS (SELECT num_ip.*, log10(bids) AS log_bids, round(avg_gap, 6) AS avg_gap,
                    round(sd_gap, 6) AS sd_gap
             FROM num_ip JOIN stats USING (bidder_id)),
    long AS ({" UNION ALL ".join(
        f"SELECT outcome, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM wide WHERE {m} IS NOT NULL"
        for m in _BOX_METRICS)}),
    boxes AS (SELECT metric, outcome, count(*) AS n, quantile_cont(v, 0.25) AS q1,
                     quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
              FROM long GROUP BY metric, outcome)
    SELECT metric, outcome, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
           round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
           round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
           count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM long JOIN boxes USING (metric, outcome) GROUP BY ALL""",
)
def boxplot_by_label(spark, d):
    stats = gaps.gap_stats(b.bids(spark, d), ["bidder_id"], "time", b.GAP_CUTOFF, SECONDS)
    wide = _bidder_profile(spark, d).join(rounded(stats, "avg_gap", "sd_gap"), "bidder_id")
    wide = wide.withColumn("log_bids", F.log10("bids"))
    long = quantiles.unpivot_metrics(wide, ["outcome"], _BOX_METRICS)
    boxes = quantiles.boxplot_stats(long, ["metric", "outcome"], "value")
    return rounded(boxes, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "boxplot_gaps_by_merchandise",
    _with(_BIDS, _BIDDERS, _TRAINING, _gap_sql("bidder_id, merchandise"))
    + """, long AS (SELECT merchandise, outcome, log10(avg_gap) AS v
                    FROM stats JOIN training USING (bidder_id) WHERE avg_gap > 0),
         boxes AS (SELECT merchandise, outcome, count(*) AS n, quantile_cont(v, 0.25) AS q1,
                          quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
                   FROM long GROUP BY merchandise, outcome)
         SELECT merchandise, outcome, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3
         FROM boxes""",
)
def boxplot_gaps_by_merchandise(spark, d):
    keys = ["bidder_id", "merchandise"]
    stats = gaps.gap_stats(b.bids(spark, d), keys, "time", b.GAP_CUTOFF, SECONDS)
    labelled = stats.join(b.training(spark, d).select("bidder_id", "outcome"), "bidder_id")
    long = labelled.filter("avg_gap > 0").withColumn("v", F.log10("avg_gap"))
    groups = ["merchandise", "outcome"]
    boxes = quantiles.quantiles(
        quantiles.value_distribution(long, groups, "v"),
        groups,
        "v",
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
    )
    return rounded(boxes, "q1", "median", "q3")


# ---------------------------------------------------------------- splits and sampling


@query(
    "stratified_split",
    _with(_BIDDERS, _SPLIT) + " SELECT bidder_id, outcome, in_train FROM split",
)
def stratified_split(spark, d):
    people = b.bidders(spark, d).select("bidder_id", "outcome")
    return sampling.stratified_split(people, "bidder_id", "outcome")


@query(
    "kfold_assignment",
    _with(_BIDDERS)
    + """ SELECT bidder_id, outcome, CAST((row_number() OVER (
              PARTITION BY outcome ORDER BY md5(CAST(bidder_id AS VARCHAR))) - 1) % 10 AS INTEGER) AS fold
          FROM bidders""",
)
def kfold_assignment(spark, d):
    people = b.bidders(spark, d).select("bidder_id", "outcome")
    return sampling.stratified_folds(people, "bidder_id", "outcome", 10)


@query(
    "oversample_minority",
    _with(_BIDDERS)
    + """ SELECT bidder_id, outcome, CAST(draw AS INTEGER) AS draw
          FROM bidders, (SELECT unnest(range(0, 5)) AS draw) WHERE outcome = 1 OR draw = 0""",
)
def oversample_minority(spark, d):
    people = b.bidders(spark, d).select("bidder_id", "outcome")
    return sampling.replicate(people, "outcome", 1, 4)


# ---------------------------------------------------------------- imputation


def _impute_sql(fit: str, target: str, key: str) -> str:
    """Z-scores of ``target`` by ``fit``, nulls filled from the 5 nearest complete rows."""
    columns = features.NUMERIC
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in columns)
    scaled = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in columns)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    distance = " + ".join(
        f"coalesce(pow(round(q.{c}, 9) - round(r.{c}, 9), 2), 0)" for c in columns
    )
    filled = ", ".join(f"round(coalesce(z.{c}, f.{c}), 6) AS {c}" for c in columns)
    means = ", ".join(f"avg({c}) AS {c}" for c in columns)
    donor = ", ".join(f"r.{c} AS {c}" for c in columns)
    return f""",
moments AS (SELECT {moments} FROM {fit}),
z AS (SELECT {key}, {scaled} FROM {target}, moments),
donors AS (SELECT * FROM (SELECT {key} AS donor, {scaled} FROM {fit}, moments) WHERE {complete}),
holes AS (SELECT * FROM z WHERE NOT ({complete})),
ranked AS (SELECT q.{key}, {donor},
                  row_number() OVER (PARTITION BY q.{key} ORDER BY {distance}, donor) AS nth
           FROM holes q, donors r),
f AS (SELECT {key}, {means} FROM ranked WHERE nth <= 5 GROUP BY {key})
SELECT z.{key}, {filled} FROM z LEFT JOIN f USING ({key})"""


def _rounded_scores(filled: DataFrame) -> DataFrame:
    return rounded(filled, *features.NUMERIC)


@query(
    "standardize_knn_impute",
    _with(_BIDS, _BIDDERS, _feature_sql("bidder_id"))
    + """, active AS (SELECT x.bidder_id, ips, auctions, bids, avg_bid_interval, sd_bid_interval
                      FROM bidders x JOIN features USING (bidder_id)),
         everyone AS (SELECT x.bidder_id, coalesce(ips, 1) AS ips, coalesce(auctions, 1) AS auctions,
                             coalesce(bids, 1) AS bids, avg_bid_interval, sd_bid_interval
                      FROM bidders x LEFT JOIN features USING (bidder_id))"""
    + _impute_sql("active", "everyone", "bidder_id"),
)
def standardize_knn_impute(spark, d):
    per_bidder = materialise(features.per_bidder(b.bids(spark, d), scale=SECONDS))
    people = b.bidders(spark, d)
    known = features.labelled_bidders(people, per_bidder)
    imputer = impute.fit_imputer(known, "bidder_id", features.NUMERIC)
    filled = imputer.transform(features.bidders_to_score(people, per_bidder))
    return _rounded_scores(filled.select("bidder_id", *features.NUMERIC))


def _pair_features(spark, d):
    """Behaviour per bidder and merchandise: many pairs have too few gaps for a mean or an sd."""
    facts = b.bids(spark, d).withColumn("pair", F.concat_ws("/", "bidder_id", "merchandise"))
    return gaps.entity_features(facts, "pair", "time", b.DISTINCT_FEATURES, b.GAP_CUTOFF, SECONDS)


@query(
    "impute_by_training_part",
    _with(
        _BIDS.replace("bids AS (", "raw AS (", 1),
        "\nbids AS (SELECT *, bidder_id || '/' || merchandise AS pair FROM raw)",
        _feature_sql("pair"),
    )
    + """, parts AS (SELECT *, row_number() OVER (ORDER BY md5(pair))
                               <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER ()) AS in_train
                     FROM features),
         fitted AS (SELECT * FROM parts WHERE in_train),
         applied AS (SELECT * FROM parts WHERE NOT in_train)"""
    + _impute_sql("fitted", "applied", "pair"),
)
def impute_by_training_part(spark, d):
    table = _pair_features(spark, d).withColumn("all", F.lit(0))
    split = materialise(sampling.stratified_split(table, "pair", "all").drop("all"))
    imputer = impute.fit_imputer(sampling.train_part(split), "pair", features.NUMERIC)
    return _rounded_scores(imputer.transform(sampling.test_part(split)))


@query(
    "knn_impute_pairs",
    _with(
        _BIDS.replace("bids AS (", "raw AS (", 1),
        "\nbids AS (SELECT *, bidder_id || '/' || merchandise AS pair FROM raw)",
        _feature_sql("pair"),
    )
    + _impute_sql("features", "features", "pair"),
)
def knn_impute_pairs(spark, d):
    table = materialise(_pair_features(spark, d))
    filled = impute.fit_imputer(table, "pair", features.NUMERIC).transform(table)
    return _rounded_scores(filled)


# ---------------------------------------------------------------- encoding


_FREQUENT = {"device": FREQUENT, "url": FREQUENT}


def _vocabulary(facts: DataFrame) -> encoding.Vocabulary:
    maps = materialise(features.factor_maps(facts, b.CATEGORICAL, _FREQUENT))
    return encoding.vocabulary(maps, b.CATEGORICAL)


def _encoded(spark, d, one_hot):
    facts = b.bids(spark, d)
    joined = joins.join_entities_to_facts(b.bidders(spark, d), facts, "bidder_id")
    return encoding.encode(joined, _vocabulary(facts), {*b.DROPPED, "outcome"}, one_hot)


def _map_sql(column: str, least: int = 0) -> str:
    return f"""
map_{column} AS (
  SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS idx_{column}
  FROM bids GROUP BY {column} HAVING count(*) >= {least})"""


_MAPS = _with(
    _BIDS,
    _BIDDERS,
    _map_sql("merchandise"),
    _map_sql("device", FREQUENT),
    _map_sql("country"),
    _map_sql("url", FREQUENT),
    "\nsizes AS (SELECT (SELECT count(*) FROM map_merchandise) AS n_merchandise, "
    "(SELECT count(*) FROM map_device) AS n_device, (SELECT count(*) FROM map_country) AS n_country, "
    "(SELECT count(*) FROM map_url) AS n_url)",
    """
mapped AS (
  SELECT bids.*, n_merchandise, n_device, n_country, n_url, idx_merchandise, idx_device,
         idx_country, idx_url
  FROM bids JOIN bidders USING (bidder_id) LEFT JOIN map_merchandise USING (merchandise)
       LEFT JOIN map_device USING (device) LEFT JOIN map_country USING (country)
       LEFT JOIN map_url USING (url), sizes)""",
)


@query(
    "ordinal_features",
    _MAPS
    + """ SELECT bid_id, CAST(pos AS INTEGER) AS pos, CAST(value AS DOUBLE) AS value FROM (
            SELECT bid_id, 0 AS pos, coalesce(idx_merchandise, n_merchandise) AS value FROM mapped
            UNION ALL SELECT bid_id, 1, coalesce(idx_device, n_device) FROM mapped
            UNION ALL SELECT bid_id, 2, time FROM mapped
            UNION ALL SELECT bid_id, 3, coalesce(idx_country, n_country) FROM mapped
            UNION ALL SELECT bid_id, 4, coalesce(idx_url, n_url) FROM mapped)""",
)
def ordinal_features(spark, d):
    return encoding.explode_vector(_encoded(spark, d, one_hot=False), ["bid_id"])


@query(
    "onehot_features",
    _MAPS
    + """ SELECT bid_id, CAST(pos AS INTEGER) AS pos, CAST(value AS DOUBLE) AS value FROM (
            SELECT bid_id, idx_merchandise AS pos, 1 AS value FROM mapped
            UNION ALL SELECT bid_id, n_merchandise + idx_device, 1 FROM mapped
            UNION ALL SELECT bid_id, n_merchandise + n_device, time FROM mapped
            UNION ALL SELECT bid_id, n_merchandise + n_device + 1 + idx_country, 1 FROM mapped
            UNION ALL SELECT bid_id, n_merchandise + n_device + 1 + n_country + idx_url, 1 FROM mapped)
          WHERE pos IS NOT NULL""",
)
def onehot_features(spark, d):
    return encoding.explode_vector(_encoded(spark, d, one_hot=True), ["bid_id"], sparse=True)


@query(
    "feature_arity",
    _MAPS
    + """ SELECT 0 AS pos, n_merchandise + 1 AS arity FROM sizes UNION ALL SELECT 1, n_device + 1 FROM sizes
          UNION ALL SELECT 3, n_country + 1 FROM sizes UNION ALL SELECT 4, n_url + 1 FROM sizes""",
)
def feature_arity(spark, d):
    """Categories per vector position, as the trees are told."""
    arity = encoding.categorical_arity(_encoded(spark, d, one_hot=False))
    return spark.createDataFrame(sorted(arity.items()), "pos int, arity bigint")


@query(
    "labelled_features",
    _MAPS
    + """ SELECT bid_id, CAST(outcome AS DOUBLE) AS label, CAST(time AS DOUBLE) AS time,
                 CAST(coalesce(idx_merchandise, n_merchandise) AS DOUBLE) AS merchandise_idx,
                 CAST(coalesce(idx_device, n_device) AS DOUBLE) AS device_idx,
                 CAST(coalesce(idx_country, n_country) AS DOUBLE) AS country_idx,
                 CAST(coalesce(idx_url, n_url) AS DOUBLE) AS url_idx
          FROM mapped JOIN bidders USING (bidder_id)""".replace("SELECT bid_id", "SELECT mapped.bid_id"),
)
def labelled_features(spark, d):
    encoded = encoding.labelled(_encoded(spark, d, one_hot=False), "outcome")
    x = vector_to_array("features")
    names = ["merchandise_idx", "device_idx", "time", "country_idx", "url_idx"]
    return encoded.select("bid_id", "label", *[x[i].alias(n) for i, n in enumerate(names)])


@query(
    "forest_bins",
    _MAPS + f" SELECT greatest({models.MIN_BINS}, n_merchandise + 1, n_device + 1, n_country + 1, n_url + 1) AS bins FROM sizes",
)
def forest_bins(spark, d):
    """The bins that a forest over these columns needs."""
    sizes = _vocabulary(b.bids(spark, d)).sizes
    return spark.createDataFrame([(models.random_forest(sizes).getMaxBins(),)], "bins bigint")


@query(
    "informative_device_encoding",
    f"""WITH found AS (SELECT * FROM ({_negentropy_sql("device")})
              WHERE bots >= 1 AND humans + bots > {MIN_LEVEL_ROWS} AND negentropy > -0.5),
        known AS (SELECT device AS level, row_number() OVER (ORDER BY device) - 1 AS idx FROM found),
        facts AS (SELECT event_id AS bid_id, 'd' || (event_id % 37) AS device FROM events)
        SELECT bid_id, CAST(coalesce(idx, (SELECT count(*) FROM known)) AS DOUBLE) AS device_idx
        FROM facts LEFT JOIN known ON device = level""",
)
def informative_device_encoding(spark, d):
    """Devices whose label share tells something among the training bidders, as a vocabulary."""
    levels = profiles.attribute_informativeness(_profile(spark, d, "device"))
    chosen = levels.filter((F.col("bots") >= 1) & (F.col("humans") + F.col("bots") > MIN_LEVEL_ROWS))
    chosen = chosen.filter("negentropy > -0.5").select(F.col("device").alias("level"))
    maps = frequency.factor_map(chosen).select(F.lit("device").alias("column"), "level", "idx")
    words = encoding.vocabulary(materialise(maps), ["device"])
    return encoding.indexed(b.bids(spark, d).select("bid_id", "device"), words).select("bid_id", "device_idx")


_FOLDED = f"""
folds AS (SELECT bidder_id, outcome, (row_number() OVER (PARTITION BY outcome
            ORDER BY md5(CAST(bidder_id AS VARCHAR))) - 1) % {CV_FOLDS} AS fold FROM training),
long AS (SELECT bidder_id, 'device' AS "column", device AS level FROM bids
         UNION ALL SELECT bidder_id, 'country', country FROM bids),
outside AS (SELECT k.fold, "column", level, count(*) FILTER (outcome = 0) AS humans, count(*) FILTER (outcome = 1) AS bots
            FROM long JOIN folds USING (bidder_id), (SELECT unnest(range({CV_FOLDS})) AS fold) k
            WHERE folds.fold <> k.fold GROUP BY ALL),
shared AS (SELECT *, CASE WHEN bots = 0 OR humans = 0 THEN 0.0
                          ELSE p * log2(p) + (1 - p) * log2(1 - p) END AS negentropy
           FROM (SELECT *, bots / CAST(humans + bots AS DOUBLE) AS p FROM outside)),
found AS (SELECT * FROM shared WHERE bots >= 1 AND humans + bots > {MIN_LEVEL_ROWS} AND negentropy > -0.46),
words AS (SELECT *, row_number() OVER (PARTITION BY fold, "column" ORDER BY level) - 1 AS idx FROM found)"""


def _fold_words(spark, d):
    """Folds of the training bidders, and what tells something about a label in each one's training part."""
    people = b.training(spark, d).select("bidder_id", "outcome")
    folds = materialise(sampling.stratified_folds(people, "bidder_id", "outcome", CV_FOLDS))
    found = materialise(
        frequency.informative_by_fold(
            b.bids(spark, d), folds, ["device", "country"], "bidder_id", "outcome", CV_FOLDS, MIN_LEVEL_ROWS, -0.46
        )
    )
    return folds, found, frequency.fold_vocabulary(found)


@query(
    "informative_levels_by_fold",
    _with(_BIDS, _BIDDERS, _TRAINING, _FOLDED)
    + """ SELECT CAST(fold AS INTEGER) AS fold, "column", level, CAST(idx AS DOUBLE) AS idx, humans, bots,
                 round(negentropy, 9) AS negentropy FROM words""",
)
def informative_levels_by_fold(spark, d):
    _, found, words = _fold_words(spark, d)
    return rounded(found.join(words, ["fold", "column", "level"]), "negentropy", digits=9)


@query(
    "informative_encoding_by_fold",
    _with(_BIDS, _BIDDERS, _TRAINING, _FOLDED)
    + """ SELECT bid_id, CAST(folds.fold AS INTEGER) AS fold,
                 CAST(coalesce(idx, (SELECT count(*) FROM words s WHERE s.fold = folds.fold AND s."column" = 'device'), 0)
                      AS DOUBLE) AS device_idx
          FROM bids JOIN folds USING (bidder_id)
               LEFT JOIN words ON words.fold = folds.fold AND words."column" = 'device' AND words.level = device""",
)
def informative_encoding_by_fold(spark, d):
    """Every bid of a training bidder, encoded by the levels that the other folds tell."""
    folds, _, words = _fold_words(spark, d)
    facts = b.bids(spark, d).select("bid_id", "bidder_id", "device").join(folds.select("bidder_id", "fold"), "bidder_id")
    return encoding.indexed_by_fold(facts, words, "device").select("bid_id", "fold", "device_idx")


# ---------------------------------------------------------------- scores and metrics


_RULE = """
scored AS (SELECT *, CASE WHEN auction < 20 THEN 1.0 ELSE 0.0 END AS pred FROM di),
scores AS (SELECT bidder_id, outcome, avg(CAST(pred AS DOUBLE)) AS prob FROM scored
           GROUP BY bidder_id, outcome)"""


def _auc_sql(groups: str, source: str) -> str:
    by = f"PARTITION BY {groups}" if groups else ""
    keys = f"{groups}, " if groups else ""
    group_by = f"GROUP BY {groups}" if groups else ""
    return f"""
ties AS (SELECT {keys}prob, count(*) FILTER (outcome = 1) AS pos, count(*) FILTER (outcome <> 1) AS neg
         FROM {source} GROUP BY {keys}prob),
above AS (SELECT *, coalesce(sum(pos) OVER ({by} ORDER BY prob DESC
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS higher FROM ties),
areas AS (SELECT {keys}CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
                 sum(neg * higher) / CAST(nullif(sum(pos) * sum(neg), 0) AS DOUBLE) AS auc_low,
                 sum(neg * (higher + pos)) / CAST(nullif(sum(pos) * sum(neg), 0) AS DOUBLE) AS auc_high
          FROM above {group_by})"""


_AREAS = """positives, negatives, round(auc_low, 9) AS auc_low, round(auc_high, 9) AS auc_high,
            round((auc_low + auc_high) / 2, 9) AS auc"""


def _rounded_areas(areas: DataFrame) -> DataFrame:
    return rounded(areas, "auc_low", "auc_high", "auc", digits=9)


@query(
    "entity_score",
    ALL + "," + _RULE + " SELECT bidder_id, outcome, round(prob, 9) AS prob FROM scores",
)
def entity_score(spark, d):
    scores = _rule_scores(spark, d)
    return rounded(scores, "prob", digits=9)


@query(
    "auc_of_entities",
    ALL + "," + _RULE + "," + _auc_sql("", "scores") + f" SELECT {_AREAS} FROM areas",
)
def auc_of_entities(spark, d):
    scores = _rule_scores(spark, d)
    return _rounded_areas(metrics.area_under_roc(scores))


@query(
    "auc_by_group",
    "WITH docs AS (SELECT lang, round(n_chars / 100.0) AS prob, toxic AS outcome "
    "FROM documents JOIN labels USING (doc_id)),"
    + _auc_sql("lang", "docs")
    + f" SELECT lang, {_AREAS} FROM areas",
)
def auc_by_group(spark, d):
    docs = b.documents_with_labels(spark, d).filter(F.col("toxic").isNotNull())
    scored = docs.select("lang", F.round(F.col("n_chars") / 100).alias("prob"), "toxic")
    return _rounded_areas(metrics.area_under_roc(scored, "prob", "toxic", ["lang"]))


@query(
    "fold_mean_sd",
    ALL
    + ","
    + _RULE
    + """, folds AS (SELECT bidder_id, (row_number() OVER (PARTITION BY outcome
                        ORDER BY md5(CAST(bidder_id AS VARCHAR))) - 1) % 10 AS fold FROM training),
          folded AS (SELECT * FROM scores JOIN folds USING (bidder_id)),"""
    + _auc_sql("fold", "folded")
    + """, per_fold AS (SELECT (auc_low + auc_high) / 2 AS auc FROM areas)
          SELECT count(auc) AS folds, round(avg(auc), 9) AS avg, round(stddev_samp(auc), 9) AS sd
          FROM per_fold""",
)
def fold_mean_sd(spark, d):
    people = b.training(spark, d).select("bidder_id", "outcome")
    folds = sampling.stratified_folds(people, "bidder_id", "outcome", 10)
    scores = metrics.entity_scores(_rule(b.bids(spark, d)), "bidder_id", label=None)
    areas = metrics.area_under_roc(scores.join(folds, "bidder_id"), groups=["fold"])
    return rounded(metrics.mean_and_sd(areas, "auc"), "avg", "sd", digits=9)


@query(
    "row_accuracy",
    ALL
    + ","
    + _RULE
    + """ SELECT merchandise, count(*) AS "rows",
                 round(avg(CAST(pred = outcome AS DOUBLE)), 9) AS accuracy
          FROM scored GROUP BY merchandise""",
)
def row_accuracy(spark, d):
    counts = _counts_by_label(spark, d, "merchandise", "pred", facts=_rule(b.bids(spark, d)))
    scores = metrics.accuracy(counts, "outcome", "pred", ["merchandise"], rows="count")
    return rounded(scores, "accuracy", digits=9)


@query(
    "default_scores",
    ALL
    + ","
    + _RULE
    + """ SELECT bidder_id, round(coalesce(prob, 0.0), 9) AS prob
          FROM bidders LEFT JOIN scores USING (bidder_id)""",
)
def default_scores(spark, d):
    scores = _rule_scores(spark, d)
    everyone = metrics.with_default_score(b.bidders(spark, d), scores, "bidder_id", 0.0)
    return rounded(everyone, "prob", digits=9)


# ---------------------------------------------------------------- files


@query(
    "csv_roundtrip",
    _with(_BIDS) + " SELECT * FROM bids",
)
def csv_roundtrip(spark, d):
    # Names with dots, as the schema writer has to clean them.
    source = b.bids(spark, d).withColumnRenamed("bid_id", "bid.id")
    data, schema = scratch_path(spark, "bids-csv"), scratch_path(spark, "bids-schema")
    delimited.write_table(source, data)
    schema_files.write_schema(source, schema)
    table = delimited.read_table(spark, data, schema_files.read_schema(spark, schema), "NA")
    longs = {c: F.col(c).cast("bigint") for c in ("bid_id", "bidder_id", "time")}
    return sanitise_names(table).withColumns(longs)


@query(
    "factor_map_roundtrip",
    _with(_BIDS, _map_sql("country"), _map_sql("device", FREQUENT), _map_sql("url", FREQUENT))
    + """ SELECT 'country' AS "column", country AS level, CAST(idx_country AS DOUBLE) AS idx FROM map_country
          UNION ALL SELECT 'device', device, CAST(idx_device AS DOUBLE) FROM map_device
          UNION ALL SELECT 'url', url, CAST(idx_url AS DOUBLE) FROM map_url""",
)
def factor_map_roundtrip(spark, d):
    columns = ["country", "device", "url"]
    maps = materialise(features.factor_maps(b.bids(spark, d), columns, _FREQUENT))
    paths = {column: scratch_path(spark, f"{column}-map") for column in columns}
    factor_maps.write_factor_maps(maps, paths)
    return factor_maps.long_factor_maps(spark, paths)


_BAD_LINES = """
lines AS (
  SELECT CASE WHEN bid_id % 101 = 0 THEN bid_id || ',' || merchandise
              WHEN bid_id % 97 = 0 THEN bid_id || ',' || merchandise || ',t' || time || ',' || auction
              WHEN bid_id % 89 = 0 THEN bid_id || ',' || merchandise || ',' || time || ',' || auction || ',x'
              ELSE bid_id || ',' || merchandise || ',' || time || ',' || auction END AS text, * FROM bids)"""


@query(
    "rejected_lines",
    _with(_BIDS, _BAD_LINES)
    + """ SELECT text, CASE WHEN bid_id % 101 <> 0 AND bid_id % 97 = 0 THEN 'time' END AS "column",
                 CASE WHEN bid_id % 101 = 0 THEN '2 values instead of 4'
                      WHEN bid_id % 97 = 0 THEN 'no decimal(38,0): t' || time ELSE '5 values instead of 4' END AS reason, 1 AS places
          FROM lines WHERE bid_id % 101 = 0 OR bid_id % 97 = 0 OR bid_id % 89 = 0""",
)
def rejected_lines(spark, d):
    """Bad lines of a file with short and long rows and bad numbers; no two share file and line."""
    good = F.concat_ws(",", "bid_id", "merchandise", "time", "auction")
    text = (
        F.when(F.col("bid_id") % 101 == 0, F.concat_ws(",", "bid_id", "merchandise"))
        .when(F.col("bid_id") % 97 == 0, F.concat_ws(",", "bid_id", "merchandise", F.concat(F.lit("t"), "time"), "auction"))
        .when(F.col("bid_id") % 89 == 0, F.concat_ws(",", good, F.lit("x")))
        .otherwise(good)
    )
    path = scratch_path(spark, "bad-lines")
    b.bids(spark, d).select(text).write.text(path)
    schema = StructType([schema_files.parse_schema_line(x) for x in ("bid_id decimal", "merchandise string", "time decimal", "auction int")])
    found = rejects.read_checked(spark, path, schema, "NA").rejects
    places = found.groupBy("file", "line").agg(F.count("*").cast("int").alias("places"))
    return found.join(places, ["file", "line"]).select("text", "column", "reason", "places")


@query(
    "csv_header_roundtrip",
    _with(_BIDS) + " SELECT *, auction / 4.0 AS quarter FROM bids",
)
def csv_header_roundtrip(spark, d):
    """Names and types come from the file, which is compressed."""
    path = scratch_path(spark, "header-csv")
    table = b.bids(spark, d).withColumn("quarter", F.col("auction") / 4)
    table.write.option("header", "true").option("compression", "gzip").csv(path)
    longs = {c: F.col(c).cast("bigint") for c in ("bid_id", "bidder_id")}
    return delimited.read_with_header(spark, path).withColumns(longs)


@query(
    "submission_read_back",
    ALL + "," + _RULE + " SELECT bidder_id, round(prob, 9) AS prob FROM scores",
)
def submission_read_back(spark, d):
    """A submission by the values that its text holds."""
    path = scratch_path(spark, "submission")
    delimited.write_submission(_rule_scores(spark, d), path)
    schema = StructType([schema_files.parse_schema_line(x) for x in ("bidder_id decimal", "prob double")])
    table = delimited.require_values(delimited.read_table(spark, path, schema))
    return rounded(table.withColumn("bidder_id", F.col("bidder_id").cast("bigint")), "prob", digits=9)


@query("bids_in_parts", _with(_BIDS) + " SELECT * FROM bids")
def bids_in_parts(spark, d):
    """Bids added part by part to a typed table that is empty at first, by way of a stored table in partitions."""
    facts = b.bids(spark, d)
    parts = [facts.filter(F.col("merchandise").startswith(x) == like) for x, like in (("p", True), ("p", False))]
    whole = sampling.union_all([empty_table(spark, facts.schema), *parts])
    return materialise(whole, partition_by=["merchandise"]).select(*facts.columns)

@query(
    "text_sinks",
    ALL + "," + _RULE + """ SELECT 'scored' AS sink, count(*) AS "lines",
               CAST(sum(length(bid_id || ',' || bidder_id || ',' || outcome || ',') + 3) AS BIGINT) AS characters
          FROM scored
          UNION ALL SELECT 'submission', count(*), 0 FROM scores""",
)
def text_sinks(spark, d):
    """Lines of the scored rows, compressed, and of a submission, read back as text."""
    scored_path, submission_path = scratch_path(spark, "scored"), scratch_path(spark, "submission")
    delimited.write_scored(_rule(_labelled_bids(spark, d)), scored_path)
    delimited.write_submission(_rule_scores(spark, d), submission_path)
    size = F.sum(F.char_length("value"))
    scored = delimited.read_lines(spark, scored_path).agg(F.count("*").alias("lines"), size.alias("characters"))
    submission = delimited.read_lines(spark, submission_path).agg(
        F.count("*").alias("lines"), F.lit(0).cast("bigint").alias("characters")
    )
    return sampling.union_all(
        [scored.withColumn("sink", F.lit("scored")), submission.withColumn("sink", F.lit("submission"))]
    )


# ---------------------------------------------------------------- models


def _prepared(spark, d):
    # Stored, as bids are made from JSON and the model jobs pass over them a dozen times.
    facts = materialise(b.bids(spark, d))
    per_bidder = materialise(features.per_bidder(facts, scale=SECONDS))
    people = b.bidders(spark, d)
    return facts, features.labelled_bidders(people, per_bidder), features.bidders_to_score(people, per_bidder)


def _cv(spark, d, model_maker, one_hot):
    facts, known, _ = _prepared(spark, d)
    # Every fold is validated, so every bidder with bids is scored once.
    folds = materialise(sampling.stratified_folds(known, "bidder_id", "outcome", CV_FOLDS))

    def prepare(train, validation):
        return features.imputed_pair(train, validation)[:2]

    areas, _ = models.cross_validate(
        facts, folds, prepare, _vocabulary(facts), model_maker, CV_FOLDS, one_hot, parallelism=CV_FOLDS, balanced=True
    )
    return rounded(_rounded_areas(areas), "auc_by_strength", digits=9)


@query(
    "svm_cv_recomputed",
    _with(_BIDS, _BIDDERS)
    + f""", known AS (SELECT * FROM bidders WHERE bidder_id IN (SELECT bidder_id FROM bids)),
          folds AS (SELECT *, (row_number() OVER (PARTITION BY outcome
                       ORDER BY md5(CAST(bidder_id AS VARCHAR))) - 1) % {CV_FOLDS} AS fold FROM known)
          SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (outcome = 1) AS positives,
                 count(*) FILTER (outcome = 0) AS negatives, true AS same_area, true AS same_rows FROM folds GROUP BY fold""",
)
def svm_cv_recomputed(spark, d):
    """Cross-validation again from the text it left: rows of every fold, and areas by counting pairs of bidders."""
    facts, known, _ = _prepared(spark, d)
    folds = materialise(sampling.stratified_folds(known, "bidder_id", "outcome", CV_FOLDS))
    path = scratch_path(spark, "cv-text")
    areas, _ = models.cross_validate(
        facts, folds, lambda *parts: features.imputed_pair(*parts)[:2], _vocabulary(facts), models.linear_svm, CV_FOLDS,
        result_dir=path, parallelism=CV_FOLDS, balanced=True,
    )
    words = ("bid_id decimal", "bidder_id decimal", "outcome int", "pred double")
    schema = StructType([schema_files.parse_schema_line(x) for x in words])
    scored = sampling.union_all(
        [delimited.read_model_table(spark, f"{path}/result_{i}", schema).withColumn("fold", F.lit(i)) for i in range(CV_FOLDS)]
    )
    shares = scored.groupBy("fold", "bidder_id", "outcome").agg(F.avg("pred").alias("share"), F.count("*").alias("n"))
    counts = shares.groupBy("fold", "share").agg(
        F.count_if(F.col("outcome") == 1).alias("pos"), F.count_if(F.col("outcome") == 0).alias("neg"), F.sum("n").alias("n")
    )
    below = F.coalesce(F.sum("neg").over(W.partitionBy("fold").orderBy("share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    beaten = counts.withColumn("_won", F.col("pos") * (below + F.col("neg") / 2))
    pairs = beaten.groupBy("fold").agg(F.sum("_won").alias("won"))
    sizes = counts.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "n")])
    facts_of = joins.join_entities_to_facts(folds, facts, "bidder_id").groupBy("fold").agg(F.count("*").alias("_n"))
    told = areas.select("fold", "auc", "positives", "negatives").join(pairs, "fold").join(sizes, "fold").join(facts_of, "fold")
    again = F.col("won") / (F.col("pos") * F.col("neg"))
    return told.select(
        F.col("fold").cast("int").alias("fold"), "positives", "negatives",
        (F.abs(again - F.col("auc")) < 1e-9).alias("same_area"), (F.col("n") == F.col("_n")).alias("same_rows"),
    )


@query("rf_cv_auc")
def rf_cv_auc(spark, d):
    return _cv(spark, d, models.random_forest, one_hot=False)


@query("svm_cv_auc")
def svm_cv_auc(spark, d):
    return _cv(spark, d, models.linear_svm, one_hot=True)


def _submission(spark, d, model_maker, one_hot):
    facts, known, everyone = _prepared(spark, d)
    train, to_score, _ = features.imputed_pair(known, everyone)
    path = scratch_path(spark, "model")
    models.train_job(facts, train, _vocabulary(facts), model_maker, one_hot, path, balanced=True)
    output = scratch_path(spark, "submission")
    return models.submission_job(facts, to_score, path, output, strength=True)


@query("rf_submission")
def rf_submission(spark, d):
    return _submission(spark, d, models.random_forest, one_hot=False)


@query("svm_submission")
def svm_submission(spark, d):
    return _submission(spark, d, models.linear_svm, one_hot=True)


@query("rf_multiclass_accuracy")
def rf_multiclass_accuracy(spark, d):
    table = b.table(spark, d, "embeddings").select(
        "vec_id", "label", array_to_vector("embedding").alias("vector")
    )
    forest = RandomForestClassifier(numTrees=10, maxDepth=4, maxBins=100, seed=11)
    return models.cross_validated_accuracy(table, "vec_id", "label", ["vector"], forest, 10)


@query(
    "fold_population",
    _with(_BIDS, _BIDDERS)
    + f""", known AS (SELECT * FROM bidders WHERE bidder_id IN (SELECT bidder_id FROM bids)),
          folds AS (SELECT *, (row_number() OVER (PARTITION BY outcome
                       ORDER BY md5(CAST(bidder_id AS VARCHAR))) - 1) % {CV_FOLDS} AS fold FROM known)
          SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (outcome = 1) AS positives,
                 count(*) FILTER (outcome = 0) AS negatives FROM folds GROUP BY fold""",
)
def fold_population(spark, d):
    """Who is validated in which fold of the cross-validation jobs."""
    _, known, _ = _prepared(spark, d)
    folds = sampling.stratified_folds(known, "bidder_id", "outcome", CV_FOLDS)
    counts = [F.count_if(F.col("outcome") == v).alias(n) for v, n in ((1, "positives"), (0, "negatives"))]
    return folds.groupBy(F.col("fold").cast("int").alias("fold")).agg(*counts)


_AGREEING = _with(_BIDS, _BIDDERS) + """
SELECT bidder_id, count(*) AS "rows", CAST(1 AS DOUBLE) AS agreeing FROM bids JOIN bidders USING (bidder_id) GROUP BY bidder_id"""


def _agreeing(spark, d, model_maker, one_hot, recomputed):
    """Share of each scored bidder's rows whose score equals one recomputed from the model's parts."""
    facts, known, everyone = _prepared(spark, d)
    train, to_score, _ = features.imputed_pair(known, everyone)
    path = scratch_path(spark, "model")
    models.train_job(facts, train, _vocabulary(facts), model_maker, one_hot, path, balanced=True)
    # The model and its vocabulary as they were saved.
    model, words = load_model(f"{path}/pipeline"), models.saved_vocabulary(facts, path)
    joined = encoding.indexed(joins.join_entities_to_facts(to_score, facts, "bidder_id"), words)
    scored = model.transform(joined)
    strength = "probability" if "probability" in scored.columns else "rawPrediction"
    said = vector_to_array(strength)[1]
    again = recomputed(model.stages[-1], F.col("features"))
    same = F.abs(said - again) <= 1e-9 * (1 + F.abs(again))
    threshold = 0.5 if strength == "probability" else 0.0
    same &= (F.col("prediction") == 1) == (again > threshold)
    return scored.groupBy("bidder_id").agg(
        F.count("*").alias("rows"), (F.count_if(same) / F.count("*")).alias("agreeing")
    )


@query("svm_scores_recomputed", _AGREEING)
def svm_scores_recomputed(spark, d):
    return _agreeing(spark, d, models.linear_svm, True, trees.linear_margin)


@query("forest_scores_recomputed", _AGREEING)
def forest_scores_recomputed(spark, d):
    def recomputed(model, features):
        return trees.forest_probability(model, vector_to_array(features))

    return _agreeing(spark, d, models.random_forest, False, recomputed)
