"""Mixing sources to target token counts by entropy balancing.

Each document gets a rate of repetition. Of all rates between 0 and ``most`` that meet every
source's token target, the ones closest to uniform in (two-sided) relative entropy are taken; they
tilt the documents exponentially by their size: rate / (most - rate) = exp(lambda * size / mean).
The convex dual has one lambda per source. Newton steps on it are aggregations over the counts of
(source, size); the lambdas stay in a table. Rates become whole copies by systematic rounding over
the documents of a source in order of size, which misses a target by about one document at most.

Defined cases: null is a source of its own, ordered last; null and empty texts have size 0 and no
words to take; a source whose sizes are all 0 has target 0; without documents the result is empty;
rows that repeat a document are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actorlens.operators.joins import join_on
from actorlens.operators.ordering import digest_rank, ordered_index
from actorlens.sources.storage import checkpointed, materialise

#: Starting points of the rounding that are tried for every source.
STARTS = 16


def word_count(text: str = "text") -> Column:
    """Maximal runs of characters other than [\\x20\\x09-\\x0D]; 0 for null."""
    count = F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+"))
    return F.coalesce(count, F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """(source, source_size, target, mean) from rows (source, size).

    The weights repeat over the sources in code-point order. A target is its weight's share until
    it would pass ``most`` times its source's size; the excess goes to the others by weight. That is
    target = min(cap, theta * weight) for one theta, found by raising it until no more targets stop.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    named = totals.withColumns({"_last": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    sources = checkpointed(
        ordered_index(named, "_last", "_name").select(
            "source", "source_size", (F.col("source_size") / F.col("_docs")).alias("mean"),
            weight.cast("double").alias("_weight"), (F.lit(most) * F.col("source_size")).alias("_cap"),
        )
    )
    everything = sources.agg(F.sum("source_size"), F.sum("_weight")).first()
    if everything[0] is None:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"), "mean")
    wanted = min(share, most) * everything[0]
    theta, stopped = wanted / everything[1], -1
    while True:
        full = F.lit(theta) * F.col("_weight") >= F.col("_cap")
        row = sources.agg(
            F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if row[0] == stopped or not row[2]:
            break
        stopped, theta = row[0], (wanted - (row[1] or 0.0)) / row[2]
    target = F.when(full, F.col("_cap")).otherwise(F.lit(theta) * F.col("_weight"))
    return sources.select("source", "source_size", target.alias("target"), "mean")


def _rate(most: float) -> Column:
    """A document's rate under its source's lambda."""
    tilted = F.lit(most) / (1 + F.exp(-F.col("lambda") * F.col("size") / F.col("mean")))
    return (
        F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("source_size"), most).otherwise(tilted)
    )


def balance(counts: DataFrame, targets: DataFrame, most: float, rounds: int = 60) -> DataFrame:
    """``targets`` with ``lambda``, from counts (source, size, n).

    A Newton step that leaves the interval known to hold the solution is replaced by its middle.
    """
    state = checkpointed(
        targets.withColumns({"lambda": F.lit(0.0), "_low": F.lit(-700.0), "_high": F.lit(700.0), "_miss": F.lit(1.0)})
    )
    for _ in range(rounds):
        here = join_on(counts, state, ["source"])
        x, rate = F.col("size") / F.col("mean"), F.col("_rate")
        sums = (
            here.filter("source_size > 0")
            .withColumn("_rate", _rate(most))
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * x * rate).alias("_got"),
                F.sum(F.col("n") * x * x * rate * (1 - rate / most)).alias("_slope"),
            )
        )
        wanted = F.col("target") / F.col("mean")
        joined = join_on(state, sums, ["source"], "left")
        miss = F.col("_got") - wanted
        low = F.when(miss < 0, F.col("lambda")).otherwise(F.col("_low"))
        high = F.when(miss > 0, F.col("lambda")).otherwise(F.col("_high"))
        step = F.col("lambda") - miss / F.nullif(F.col("_slope"), F.lit(0.0))
        inside = (step > low) & (step < high)
        free = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
        state = checkpointed(
            joined.select(
                "source", "source_size", "target", "mean",
                F.when(free & (miss != 0), F.when(inside, step).otherwise((low + high) / 2))
                .otherwise(F.col("lambda")).alias("lambda"),
                low.alias("_low"), high.alias("_high"),
                F.when(free, F.abs(miss) / wanted).otherwise(0.0).alias("_miss"),
            )
        )
        if (state.agg(F.max("_miss")).first()[0] or 0.0) < 1e-10:
            break
    # Sums of doubles differ in their last digits between runs.
    return state.withColumn("lambda", F.round("lambda", 9)).drop("_low", "_high", "_miss")


def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 2,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies) of every document."""
    sized = materialise(
        docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    )
    counts = checkpointed(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(sized, share, weights, most)
    balanced = balance(counts, targets, most)
    bins = join_on(counts, balanced, ["source"]).withColumn("rate", F.round(_rate(most), 12))
    # Expected copies of the source's smaller documents; one row per distinct size.
    smaller = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(smaller), F.lit(0.0)))

    def passed(rank: Column, start: Column) -> Column:
        return F.floor(F.col("_before") + rank * F.col("rate") + start)

    start = F.col("_start")
    tried = bins.withColumn("_start", F.explode(F.array(*[F.lit((i + 0.5) / STARTS) for i in range(STARTS)])))
    taken = F.sum((passed(F.col("n"), start) - passed(F.lit(0), start)) * F.col("size"))
    starts = (
        tried.groupBy("source", "target", "_start")
        .agg(taken.alias("_taken"))
        .groupBy("source")
        .agg(F.min_by("_start", F.struct(F.abs(F.col("_taken") - F.col("target")), "_start")).alias("_start"))
    )
    bins = join_on(bins, starts, ["source"])
    ranked = digest_rank(sized, ["source", "size"], "_key").drop("group_rows")
    placed = join_on(ranked, bins, ["source", "size"])
    copies = F.when(F.col("rate") >= most, F.lit(most)).otherwise(
        F.least(passed(F.col("rank"), start) - passed(F.col("rank") - 1, start), F.lit(most))
    )
    return placed.select(
        F.col("_key").alias(key), "source", "size", "source_size", "target", "rate", copies.cast("bigint").alias("copies")
    )
