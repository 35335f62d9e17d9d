import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from actorlens.operators import metrics
from tests.conftest import rows

SCHEMA = "prob double, outcome int"


def area(spark, pairs):
    return metrics.area_under_roc(spark.createDataFrame(pairs, SCHEMA)).first()


def pair_count(pairs):
    """Area by comparing each positive with each negative."""
    pos = [p for p, y in pairs if y == 1]
    neg = [p for p, y in pairs if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def sweep(pairs):
    """Area by walking down the scores, in the given order within ties."""
    humans = sum(y == 0 for _, y in pairs)
    bots = len(pairs) - humans
    total, height = 0.0, 0.0
    for _, y in sorted(pairs, key=lambda p: -p[0]):
        if y == 1:
            height += 1 / bots
        else:
            total += height / humans
    return total


def test_area_with_ties_matches_pairs_and_evaluator(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(20) / 20, rng.randrange(2)) for _ in range(300)]
    found = area(spark, pairs)
    assert found["auc"] == pytest.approx(pair_count(pairs))
    assert found["auc_low"] <= sweep(pairs) <= found["auc_high"]
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="outcome", numBins=0)
    assert found["auc"] == pytest.approx(evaluator.evaluate(spark.createDataFrame(pairs, SCHEMA)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=2, max_size=30))
def test_area_properties(spark, drawn):
    pairs = [(float(p), y) for p, y in drawn]
    if len({y for _, y in pairs}) < 2:
        assert area(spark, pairs)["auc"] is None
        return
    found, turned = area(spark, pairs), area(spark, [(-p, y) for p, y in pairs])
    assert found["auc"] == pytest.approx(pair_count(pairs))
    assert found["auc_low"] <= sweep(pairs) + 1e-12
    assert sweep(pairs) <= found["auc_high"] + 1e-12
    assert turned["auc"] == pytest.approx(1 - found["auc"])


def test_equal_scores_and_groups(spark):
    df = spark.createDataFrame(
        [("a", 0.5, 1), ("a", 0.5, 0), ("b", 0.9, 1), ("b", 0.1, 0), ("c", 0.3, 1)],
        "g string, prob double, outcome int",
    )
    out = metrics.area_under_roc(df, groups=["g"])
    assert rows(out, "g", "auc_low", "auc_high", "auc") == [
        ("a", 0.0, 1.0, 0.5),
        ("b", 1.0, 1.0, 1.0),
        ("c", None, None, None),
    ]


def test_entity_scores_and_default(spark):
    scored = spark.createDataFrame(
        [("a", 1.0, 1, 0.8), ("a", 0.0, 1, 0.4), ("b", 0.0, 0, 0.1)],
        "k string, pred double, outcome int, p1 double",
    )
    scores = metrics.entity_scores(scored, "k", probability="p1")
    assert rows(scores, "k", "prob", "outcome") == [("a", 0.5, 1), ("b", 0.0, 0)]
    means = {r["k"]: r["mean_probability"] for r in scores.collect()}
    assert means == pytest.approx({"a": 0.6, "b": 0.1})
    people = spark.createDataFrame([("a",), ("b",), ("idle",)], "k string")
    everyone = metrics.with_default_score(people, scores, "k", 0.25)
    assert rows(everyone) == [("a", 0.5), ("b", 0.0), ("idle", 0.25)]


def test_mean_sd_and_accuracy(spark):
    one = metrics.mean_and_sd(spark.createDataFrame([(0.5,)], "v double"), "v").first()
    assert (one["folds"], one["avg"], one["sd"]) == (1, 0.5, None)
    two = metrics.mean_and_sd(spark.createDataFrame([(0.5,), (1.0,)], "v double"), "v").first()
    assert two["sd"] == pytest.approx(0.5 / 2**0.5)
    scored = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "label double, prediction double")
    assert metrics.accuracy(scored, "label", "prediction").first()["accuracy"] == 0.5


def test_metric_survives_a_large_class_imbalance(spark):
    df = spark.range(5_000).select(
        (F.col("id") % 100 / 100).alias("prob"), (F.col("id") == 4_999).cast("int").alias("outcome")
    )
    assert metrics.area_under_roc(df).first()["auc"] > 0.99
