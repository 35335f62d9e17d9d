import hashlib
import random

import pytest
from pyspark.sql import functions as F

from actorlens.operators import frequency, ordering, quantiles
from tests.conftest import approx, rows


def md5(value):
    return hashlib.md5(str(value).encode()).hexdigest()


@pytest.mark.parametrize("slice_rows", [1, 40, 4096])
def test_digest_rank_numbers_every_group(spark, slice_rows):
    people = [(i, random.Random(i).choice([0, 0, 0, 1, None])) for i in range(500)]
    df = spark.createDataFrame(people, "id bigint, y int")
    out = ordering.digest_rank(df, ["y"], "id", slice_rows)
    for label in (0, 1, None):
        expected = sorted((i for i, y in people if y == label), key=md5)
        found = [r for r in out.collect() if r["y"] == label]
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"])] == expected
        assert sorted(r["rank"] for r in found) == list(range(1, len(expected) + 1))
        assert {r["group_rows"] for r in found} == {len(expected)}


def test_slices_follow_the_size_of_the_group(spark):
    df = spark.range(21_000).selectExpr("id", "if(id < 20000, 'large', 'small') AS g")
    sizes = ordering.with_slices(df, ["g"], "id", 1_000).groupBy("g", "_slice").count().collect()
    assert [r["count"] for r in sizes if r["g"] == "small"] == [1_000]
    large = [r["count"] for r in sizes if r["g"] == "large"]
    assert len(large) == 256 and max(large) < 1_000


@pytest.mark.parametrize("descending", [False, True])
def test_running_before_spans_partitions(spark, descending):
    rng = random.Random(5)
    data = [(g, v, rng.randrange(10)) for g in "abc" for v in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(data, "g string, v bigint, w bigint").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordering.running_before(df, ["v"], ["w"], ["g"], descending)
        found = {(r["g"], r["v"]): r["before_w"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in "abc":
        total = 0
        for _, v, w in sorted((d for d in data if d[0] == g), key=lambda d: d[1], reverse=descending):
            assert found[(g, v)] == total
            total += w


def test_ordered_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "level string")
    assert rows(ordering.ordered_index(df, "level")) == [("a", 0), ("b", 1), ("c", 2)]


def counts_table(spark):
    counts = {f"u{i}": 1 for i in range(80)} | {"x": 5, "y": 5, "z": 40}
    return counts, spark.createDataFrame(list(counts.items()), "level string, count bigint")


def test_cumulative_share(spark):
    counts, df = counts_table(spark)
    out = frequency.cumulative_share(df).orderBy("rank").collect()
    total, running = sum(counts.values()), 0
    for position, level in enumerate(sorted(counts, key=lambda u: (counts[u], md5(u))), 1):
        row = out[position - 1]
        running += counts[level]
        assert (row["level"], row["rank"], row["cumulative"]) == (level, position, running)
        assert row["ratio"] == pytest.approx(running / total)
    assert out[-1]["ratio"] == 1.0


def test_first_ranks(spark):
    _, df = counts_table(spark)
    shares = frequency.cumulative_share(df)
    assert frequency.first_rank_over(shares, 0.5).first()[0] == 66
    assert frequency.first_rank_over(shares, 1.0).first()[0] is None
    assert frequency.first_rank_with_count(df, 5).first()[0] == 81
    assert frequency.first_rank_with_count(df, 41).first()[0] is None


def test_top_and_frequent_levels(spark):
    _, df = counts_table(spark)
    assert [r["level"] for r in frequency.top_levels(df, 3).collect()] == ["z", "x", "y"]
    assert rows(frequency.frequent_levels(df, 5), "level") == [("x",), ("y",), ("z",)]
    chosen = frequency.frequent_levels(df, 40)
    assert frequency.share_of_rows(df, chosen).first()[0] == pytest.approx(40 / 130)


def test_heavy_levels_among_a_million_rare_ones(spark):
    """The cells rule almost all rare levels out, and the result is that of counting them all."""
    rare = spark.range(1_000_000).selectExpr("concat('r', id) AS level")
    heavy = spark.range(40).selectExpr("explode(array_repeat(concat('h', id), int(20 + id % 30))) AS level")
    nulls = spark.range(33).selectExpr("cast(null AS string) AS level")
    df = rare.union(heavy).union(nulls)
    expected = [tuple(r) for r in frequency.top_levels(frequency.level_counts(df, "level"), 30).collect()]
    assert [tuple(r) for r in frequency.heavy_levels(df, "level", 30).collect()] == expected
    summary = frequency.cell_counts(df, "level")
    kept = summary.filter(f"rows >= {expected[-1][1]}")
    assert kept.count() < 200 and summary.agg(F.sum("rows")).first()[0] == df.count()


@pytest.mark.parametrize("cells", [1, 8, 1 << 18])
def test_heavy_levels_with_ties_and_few_levels(spark, cells):
    df = spark.createDataFrame([(x,) for x in "aabbccdde"] + [(None,), (None,)], "level string")
    counts = frequency.level_counts(df, "level")
    for n in (1, 3, 5, 6, 20):
        assert frequency.heavy_levels(df, "level", n, cells).collect() == frequency.top_levels(counts, n).collect()
    assert frequency.heavy_levels(df.limit(0), "level", 3, cells).count() == 0


def test_out_of_fold_totals(spark):
    rng = random.Random(4)
    data = [(rng.choice("abc"), rng.randrange(4), rng.randrange(3)) for _ in range(60)] + [("only", 2, 5)]
    df = spark.createDataFrame(data, "level string, fold int, n bigint")
    counts = df.groupBy("level", "fold").agg(F.sum("n").alias("n"))
    expected = []
    for fold in range(4):
        for level in ("a", "b", "c", "only"):
            total = sum(n for x, f, n in data if x == level and f != fold)
            expected += [(fold, level, total)] if total else []
    assert rows(frequency.out_of_fold(counts, ["level"], ["n"], 4), "fold", "level", "n") == sorted(expected, key=repr)
    words = frequency.fold_vocabulary(
        spark.createDataFrame([(0, "c", "b"), (0, "c", "a"), (1, "c", "b"), (1, "d", "x")], "fold int, column string, level string")
    )
    assert rows(words) == [(0, "c", "a", 0.0), (0, "c", "b", 1.0), (1, "c", "b", 0.0), (1, "d", "x", 0.0)]


def test_factor_map(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    levels = frequency.sorted_levels(df, "c")
    assert rows(frequency.factor_map(levels)) == [("a", 0.0), ("b", 1.0)]


def test_quantiles_interpolate_like_type_seven(spark):
    rng = random.Random(9)
    data = [("a", rng.randrange(50)) for _ in range(333)] + [("b", 7)] + [("c", 1), ("c", 2)]
    df = spark.createDataFrame([*data, ("a", None)], "g string, v int").repartition(5)
    table = quantiles.value_distribution(df, ["g"], "v")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    out = {r["g"]: r for r in quantiles.quantiles(table, ["g"], "v", probs).collect()}
    for g in "abc":
        values = sorted(v for h, v in data if h == g)
        for name, p in probs.items():
            place = p * (len(values) - 1)
            low = int(place)
            high = min(low + 1, len(values) - 1)
            expected = values[low] + (values[high] - values[low]) * (place - low)
            assert approx(out[g][name]) == approx(expected)
        assert out[g]["n"] == len(values)


def test_boxplot_whiskers_and_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    box = quantiles.boxplot_stats(df, ["g"], "v").first()
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 5.0, 1)


def test_unpivot(spark):
    df = spark.createDataFrame([(1, 2, 3.5)], "id int, a int, b double")
    long = quantiles.unpivot_metrics(df, ["id"], ["a", "b"])
    assert rows(long, "metric", "value") == [("a", 2.0), ("b", 3.5)]
    assert long.filter(F.col("value").isNull()).isEmpty()
