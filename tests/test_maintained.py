import random

import pytest
from pyspark.sql import functions as F

from actorlens.operators import gaps, maintained
from tests.conftest import approx

EVENTS = "who string, at bigint, ip string, url string"
DISTINCT = {"ips": "ip", "urls": "url"}


def table(df):
    return sorted((tuple(approx(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most_parts, segment_rows", [(8, 1_000_000), (1, 4)])
def test_batches_in_any_order_equal_one_pass(spark, most_parts, segment_rows):
    rng = random.Random(9)
    events = [
        (rng.choice(["a", "b", "c", None]), rng.choice([None, *[rng.randrange(0, 3_000) for _ in range(9)]]), f"i{rng.randrange(6)}",
         rng.choice(["u", "v", None]))
        for _ in range(300)
    ]
    events += [("late", 50, "i", None), ("late", 10, "i", None), ("late", 10, "i", None), ("once", 7, "i", "u"), ("never", None, None, None)]
    state = maintained.MaintainedFeatures(spark, "who", "at", DISTINCT, 400, 250, most_parts, segment_rows)
    for batch in (events[200:], events[:100], events[100:200]):
        state = state.add(spark.createDataFrame(batch, EVENTS))
    whole = spark.createDataFrame(events, EVENTS)
    expected = gaps.entity_features(whole, "who", "at", DISTINCT, 400)
    assert table(state.features().select(*expected.columns)) == table(expected)
    assert len(state.ticks) <= most_parts


def test_a_batch_leaves_the_state_before_as_it_was(spark):
    first = maintained.MaintainedFeatures(spark, "who", "at", DISTINCT, 400, 250).add(
        spark.createDataFrame([("a", 100, "i", "u"), ("a", 300, "j", "u")], EVENTS)
    )
    before = table(first.features())
    second = first.add(spark.createDataFrame([("a", 200, "i", "w"), ("b", 1, "i", "u")], EVENTS))
    assert table(first.features()) == before
    assert second.gap_stats().filter("who = 'a'").first()[1:3] == (2, 100.0)


def test_only_touched_blocks_are_read_again(spark):
    """A late tick changes its own block; the summaries of all others stay the rows they were."""
    events = [("a", t, "i", "u") for t in range(0, 10_000, 10)]
    state = maintained.MaintainedFeatures(spark, "who", "at", DISTINCT, 400, 1_000).add(spark.createDataFrame(events, EVENTS))
    later = state.add(spark.createDataFrame([("a", 4_005, "i", "u")], EVENTS))
    changed = later.blocks.exceptAll(state.blocks)
    assert [r["_block"] for r in changed.collect()] == [4]


def test_empty_batches(spark):
    empty = spark.createDataFrame([], EVENTS)
    state = maintained.MaintainedFeatures(spark, "who", "at", DISTINCT, 400, 250)
    with pytest.raises(ValueError):
        state.features()
    assert state.add(empty).add(empty).features().count() == 0
    assert state.add(empty).add(spark.createDataFrame([("a", 5, "i", None)], EVENTS)).features().first()["bids"] == 1


def test_steady_gaps_have_no_spread(spark):
    events = spark.range(5_000).select(F.lit("a").alias("who"), (F.col("id") * 1_000_003).alias("at"), F.lit("i").alias("ip"), F.lit("u").alias("url"))
    state = maintained.MaintainedFeatures(spark, "who", "at", DISTINCT, 10**9, 10**8)
    for part in range(3):
        state = state.add(events.filter(F.col("at") / 1_000_003 % 3 == part))
    row = state.gap_stats().first()
    assert (row["gaps"], row["avg_gap"]) == (4_999, 1_000_003.0) and row["sd_gap"] == pytest.approx(0, abs=1e-6)
