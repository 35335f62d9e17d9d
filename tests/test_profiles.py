import math

import pytest
from pyspark.sql import functions as F

from actorlens.functions.expressions import epoch_micros, floor_div, negentropy, time_bucket
from actorlens.operators import profiles
from tests.conftest import approx, rows


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("h1", 0), ("h2", 0), ("b1", 1), ("idle", 1)], "k string, y int")


@pytest.fixture(scope="module")
def facts(spark):
    data = [("h1", "x")] * 3 + [("h2", "x")] + [("b1", "x")] * 4 + [("b1", "y")] * 2 + [("h1", "z")]
    data.append(("unlabelled", "z"))
    return spark.createDataFrame(data, "k string, a string")


def test_label_profile(facts, people):
    out = profiles.label_profile(facts, people, "a", "k", "y")
    assert rows(out, "a", "humans", "bots", "distinct_humans", "distinct_bots") == [
        ("x", 4, 4, 2, 1), ("y", 0, 2, 0, 1), ("z", 1, 0, 1, 0),
    ]
    levels = profiles.attribute_informativeness(out)
    assert rows(levels, "a", "negentropy") == [("x", -1.0), ("y", 0.0), ("z", 0.0)]
    chosen = profiles.informative(levels, min_rows=1)
    assert rows(chosen, "a") == [("y",)]
    assert profiles.coverage(chosen).first().asDict() == {"levels": 1, "bots": 2}
    none = profiles.informative(levels, min_rows=100)
    assert profiles.coverage(none).first().asDict() == {"levels": 0, "bots": 0}


def test_pivot_fills_absent_pairs_with_zero(facts, people):
    counts = profiles.count_by(facts.join(people, "k"), "a", "y")
    wide = profiles.pivot_counts(counts, "a", "y", {0: "human", 1: "bot"})
    assert rows(wide, "a", "human", "bot") == [("x", 4, 4), ("y", 0, 2), ("z", 1, 0)]
    assert rows(profiles.below(wide, "bot", 2), "a") == [("z",)]
    rolled = profiles.roll_up(counts, "y")
    assert rows(rolled) == [(0, 5), (1, 6)]


def test_distinct_profile_exact_and_sketched(spark):
    df = spark.range(1_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 10).alias("a"))
    exact = profiles.distinct_profile(df, "k", {"as": "a"})
    assert rows(exact) == [(0, 5, 500), (1, 5, 500)]
    sketched = profiles.distinct_profile(df, "k", {"as": "a"}, approximate=True)
    assert rows(sketched) == rows(exact)


def test_negentropy(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (8, 10)], "p int, n int")
    found = {r[0]: approx(r[1]) for r in df.select("p", negentropy(F.col("p"), F.col("n"))).collect()}
    expected = 0.8 * math.log2(0.8) + 0.2 * math.log2(0.2)
    assert found == {0: 0.0, 10: 0.0, 5: -1.0, 8: approx(expected)}


def test_time_helpers(spark):
    df = spark.createDataFrame([(9,), (10,), (19,), (-1,), (9_763_200_000_000_000_009,)][:4], "t bigint")
    assert rows(df.select("t", time_bucket(F.col("t"), F.lit(0), 10))) == [(-1, -1), (10, 1), (19, 1), (9, 0)]
    big = spark.sql("SELECT 9007199254740993 AS t")
    assert big.select(floor_div(F.col("t"), F.lit(1).cast("bigint"))).first()[0] == 9007199254740993
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            ts = spark.sql("SELECT timestamp_ntz'2024-07-01 12:34:56.789012' AS ts")
            assert ts.select(epoch_micros(F.col("ts"))).first()[0] == 1_719_837_296_789_012
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
