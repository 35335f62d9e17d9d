import pytest
from pyspark.sql import functions as F

from actorlens.operators import joins
from tests.conftest import rows


@pytest.fixture(scope="module")
def facts(spark):
    hot = [(i, "hot") for i in range(200)]
    return spark.createDataFrame(
        hot + [(1000, "a"), (1001, "a"), (1002, "unknown"), (1003, None)], "id bigint, k string"
    )


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([("hot", 1), ("a", 0), ("idle", 1)], "k string, y int")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1, 30, 10_000])
def test_salted_join_equals_plain_join(facts, entities, how, hot_rows):
    salted = joins.salted_join(facts, entities, "k", how, hot_rows)
    plain = facts.join(entities, "k", how)
    assert rows(salted, "id", "k", "y") == rows(plain, "id", "k", "y")


def test_salted_join_rejects_other_kinds(facts, entities):
    with pytest.raises(ValueError):
        joins.salted_join(facts, entities, "k", "full")


def test_salts_split_a_hot_key(spark, facts, entities):
    hot = joins.hot_keys(facts, ["k"], 50)
    assert rows(hot) == [("hot", 200)]


def test_entity_join_keeps_both_keys_and_drops_idle_entities(facts, entities):
    joined = joins.join_entities_to_facts(entities, facts, "k")
    assert joined.columns == ["k_left", "y", "id", "k"]
    assert joined.count() == 202
    assert joined.filter("k_left <> k").isEmpty()
    salted = joins.join_entities_to_facts(entities, facts, "k", hot_rows=20)
    assert rows(salted) == rows(joined)


def test_left_join_keeps_unlabelled_facts(facts, entities):
    labelled = joins.label_facts(facts, entities, "k", "left")
    assert labelled.count() == 204
    assert labelled.filter(F.col("y").isNull()).count() == 2


def test_lookup_gives_unknown_levels_the_map_size(spark, facts):
    factor_map = spark.createDataFrame([("a", 0.0), ("hot", 1.0)], "level string, idx double")
    out = joins.lookup_index(facts, "k", factor_map, "k_idx")
    counts = {r["k_idx"]: r["count"] for r in out.groupBy("k_idx").count().collect()}
    assert counts == {0.0: 2, 1.0: 200, 2.0: 2}


def test_members_and_non_members_are_complements(facts, entities):
    inside, outside = joins.members(facts, entities, "k"), joins.non_members(facts, entities, "k")
    assert inside.count() + outside.count() == facts.count()
    assert outside.count() == 2


def test_join_on_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert rows(joins.join_on(left, right, ["k"]), "x", "y") == [(1, 10), (2, 20)]
