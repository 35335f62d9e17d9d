import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from actorlens.operators import gaps
from tests.conftest import approx, rows

CUTOFF = 100


def brute_force(events, cutoff):
    """Gap count, mean and sd per key by plain Python."""
    result = {}
    for key in {k for k, *_ in events}:
        times = sorted(t for k, t, *_ in events if k == key)
        kept = [b - a for a, b in zip(times, times[1:]) if b - a < cutoff]
        mean = statistics.fmean(kept) if kept else None
        sd = statistics.stdev(kept) if len(kept) > 1 else None
        result[key] = (len(kept), approx(mean), approx(sd))
    return result


def stats(df, **options):
    out = gaps.gap_stats(df, ["k"], "t", CUTOFF, **options)
    return {r["k"]: (r["gaps"], approx(r["avg_gap"]), approx(r["sd_gap"])) for r in out.collect()}


def test_gap_edge_cases(spark):
    events = [
        ("one", 5),
        ("none", 0), ("none", 500),
        ("single", 0), ("single", 30), ("single", 500),
        ("two", 10), ("two", 20), ("two", 50),
        ("tied", 7), ("tied", 7), ("tied", 7), ("tied", 17),
        ("edge", 0), ("edge", 99), ("edge", 199),
        (None, 1), (None, 4), (None, 11),
    ]
    df = spark.createDataFrame(events, "k string, t bigint")
    expected = brute_force(events, CUTOFF)
    assert expected["none"] == (0, None, None)
    assert expected["edge"][0] == 1
    assert stats(df) == expected
    assert stats(df, segment_rows=1) == expected


def test_rows_without_time_end_no_gap(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 1), ("a", 4), ("b", None)], "k string, t bigint")
    for segment_rows in (1, 10_000):
        assert stats(df, segment_rows=segment_rows) == {"a": (1, 3.0, None), "b": (0, None, None)}


@pytest.mark.parametrize("segment_rows", [1, 7, 50, 10_000])
def test_hot_key_is_cut_without_losing_gaps(spark, segment_rows):
    rng = random.Random(segment_rows)
    # One key holds most rows, half of them in a burst, with many ties.
    events = [("hot", rng.randrange(0, 60)) for _ in range(300)]
    events += [("hot", rng.randrange(0, 20_000)) for _ in range(300)]
    events += [(f"k{rng.randrange(40)}", rng.randrange(0, 5_000)) for _ in range(300)]
    events += [("same", 42)] * 60
    df = spark.createDataFrame(events, "k string, t bigint")
    assert stats(df, segment_rows=segment_rows) == brute_force(events, CUTOFF)


@pytest.mark.parametrize("tick", ["id", "if(id = 0, -1000000000000, id)", "if(id < 9000, id, id * 100000)"])
def test_hot_key_is_cut_by_count(spark, tick):
    """Evenly spread ticks, one early outlier, one burst."""
    df = spark.range(10_000).select(F.lit("hot").alias("k"), F.expr(tick).cast("bigint").alias("t"))
    swept = gaps.sweep(df, ["k"], "t", 10_000, 1_000)
    segments = swept.groupBy("_segment").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
    found = segments.orderBy("_segment").collect()
    assert len(found) >= 10 and max(r["n"] for r in found) <= 1_000
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:]))


def test_segments_of_a_hot_key_give_the_same(spark):
    """A hundred thousand ticks of one key in 2,000 segments, against the same in one."""
    df = spark.range(100_000).select(F.lit("hot").alias("k"), (F.col("id") * 37 % 100_003).alias("t"))
    seconds, found = {}, {}
    for segment_rows in (1_000_000, 50):
        start = time.perf_counter()
        found[segment_rows] = stats(df, segment_rows=segment_rows)
        seconds[segment_rows] = time.perf_counter() - start
    assert found[50] == found[1_000_000]
    print(f"sweep in parts: {seconds}")


@pytest.mark.parametrize("segment_rows", [2, 10_000])
def test_responder_gaps(spark, segment_rows):
    rng = random.Random(3)
    events = [
        (i, rng.choice("abc"), rng.randrange(0, 400), rng.choice([0, 1, None])) for i in range(200)
    ]
    events.append((1000, "lonely", 1, 1))
    df = spark.createDataFrame(events, "id bigint, a string, t bigint, y int")
    out = gaps.responder_gap_stats(df, "a", "t", "id", "y", CUTOFF, segment_rows=segment_rows)
    for r in out.collect():
        ordered = sorted((t, i, y) for i, a, t, y in events if a == r["a"])
        for name, label in (("human", 0), ("bot", 1)):
            kept = [
                later[0] - earlier[0]
                for earlier, later in zip(ordered, ordered[1:])
                if later[2] == label and later[0] - earlier[0] < CUTOFF
            ]
            assert r[f"{name}_gaps"] == len(kept)
            assert approx(r[f"{name}_avg"]) == approx(statistics.fmean(kept) if kept else None)
            assert approx(r[f"{name}_sd"]) == approx(statistics.stdev(kept) if len(kept) > 1 else None)


def test_pandas_function_sees_every_tick_once(spark):
    events = [("hot", i * 3) for i in range(100)] + [("cold", 5), ("cold", 9)]
    df = spark.createDataFrame(events, "k string, t bigint")

    def total(pdf):
        return pdf.groupby("k", as_index=False).agg(n=("rows", "sum"), gap=("gap", "sum"))

    merge = [F.sum("n").alias("n"), F.sum("gap").alias("gap")]
    for pieces in (10, 1_000):
        merged = gaps.apply_to_segments(
            df, ["k"], "t", total, "k string, n bigint, gap double", merge, segment_rows=pieces
        )
        assert rows(merged) == [("cold", 2, 4.0), ("hot", 100, 297.0)]


def test_pandas_function_sees_the_groups_own_columns(spark):
    events = [("a", 1, "x"), ("a", 1, "y"), ("a", 7, "x"), ("b", 3, "z")]
    df = spark.createDataFrame(events, "k string, t bigint, ip string")

    def ips(pdf):
        found = sorted({ip for row in pdf["ips"] for ip in row})
        return pdf.iloc[:1][["k"]].assign(ips=[found])

    merged = gaps.apply_to_segments(
        df, ["k"], "t", ips, "k string, ips array<string>",
        [F.size(F.array_distinct(F.flatten(F.collect_list("ips")))).alias("ips")],
        payload=[F.collect_set("ip").alias("ips")], segment_rows=1,
    )
    assert rows(merged) == [("a", 2), ("b", 1)]
