import random

import pytest
from pyspark.sql import functions as F

from actorlens.operators import frequency, sets, sketches
from tests.conftest import rows


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(3)
    data = [(rng.choice("xyz"), rng.randrange(5), rng.choice([None, *[f"l{i}" for i in range(300)]])) for _ in range(3_000)]
    return data, spark.createDataFrame(data, "g string, day int, level string")


def test_sets_merge_and_intersect_exactly(facts):
    data, df = facts
    maps = frequency.factor_map(df.select("level").dropna().distinct())
    daily = sets.level_sets(df, ["g", "day"], "level", maps)
    held = {}
    for g, day, level in data:
        held.setdefault((g, day), set()).update([level] if level else [])
    sizes = daily.groupBy("g", "day").agg(sets.set_size().alias("n"))
    assert rows(sizes) == sorted(((*k, len(v)) for k, v in held.items()), key=repr)
    merged = sets.merge(daily, ["g"])
    whole = {g: set().union(*[v for (h, _), v in held.items() if h == g]) for g in "xyz"}
    assert rows(merged.groupBy("g").agg(sets.set_size().alias("n"))) == sorted((g, len(v)) for g, v in whole.items())
    assert {g: {r["level"] for r in sets.members(merged, ["g"], maps).collect() if r["g"] == g} for g in "xyz"} == whole
    first, second = (sets.merge(daily.filter(F.col("day") == d), ["g"]) for d in (0, 1))
    both = sets.shared(first, second, ["g"]).groupBy("g").agg(sets.set_size().alias("n"))
    assert rows(both) == sorted((g, len(held[g, 0] & held[g, 1])) for g in "xyz")
    assert daily.limit(0).agg(sets.set_size().alias("n")).first()[0] == 0


def test_last_bit_of_a_word(spark):
    maps = spark.createDataFrame([(f"l{i}", float(i)) for i in (0, 63, 64, 127, 1000)], "level string, idx double")
    df = spark.createDataFrame([("a", f"l{i}") for i in (0, 63, 64, 127, 1000, 63)] + [("a", "unknown")], "g string, level string")
    made = sets.level_sets(df, ["g"], "level", maps)
    assert made.agg(sets.set_size().alias("n")).first()[0] == 5
    assert rows(sets.members(made, ["g"], maps), "level") == rows(maps, "level")


def test_errors_of_rolled_up_sketches(spark):
    """Distinct counts within 3 percent, ranks of quantiles within 2, over sizes from 1 to 200,000 and many days."""
    df = spark.range(400_000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'large' WHEN id % 20 = 1 THEN 'middle' ELSE 'small' END AS g",
        "int(id % 30) AS day", "if(id % 2 = 0 OR id % 20 = 1, id, id % 7) AS who", "(id * 7919) % 100003 AS v",
    )
    table = sketches.sketch_table(df, ["g", "day"], {"whos": "who"}, {"vs": "v"})
    assert table.count() > 30
    shares = {f"p{p}": p / 100 for p in (1, 25, 50, 75, 99)}
    told = sketches.estimates(sketches.roll_up(table, ["g"], ["whos"], ["vs"]), ["g"], ["whos"], {"vs": shares})
    exact = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count_distinct("who").alias("n")).collect()}
    for row in told.collect():
        assert abs(row["whos"] / exact[row["g"]] - 1) <= 0.03
        assert row["rows"] == df.filter(F.col("g") == row["g"]).count()
        for name, share in shares.items():
            place = df.filter(F.col("g") == row["g"]).agg((F.count_if(F.col("v") <= row[name]) / F.count("*"))).first()[0]
            assert abs(place - share) <= 0.02


def test_sketches_of_nulls_only(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 3, 4)], "g string, who bigint, v bigint")
    table = sketches.sketch_table(df, ["g"], {"whos": "who"}, {"vs": "v"})
    told = sketches.estimates(table, ["g"], ["whos"], {"vs": {"median": 0.5}})
    assert rows(told, "g", "rows", "whos", "median") == [("a", 1, 0, None), ("b", 1, 1, 4)]
