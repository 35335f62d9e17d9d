import pytest
from pyspark.sql import functions as F

from actorlens.operators.copartitioned import CoPartitioned
from tests.conftest import rows



def counts():
    return [F.count("*").alias("n"), F.max("t").alias("last")]


def tables(spark, hot=False):
    facts = [(i % 40, i) for i in range(200)] + [(None, 1), (99, 2)] + ([(3, 1000 + i) for i in range(300)] if hot else [])
    people = [(i, f"p{i}") for i in range(45)] + [(None, "none")]
    return spark.createDataFrame(facts, "k bigint, t bigint"), spark.createDataFrame(people, "k bigint, name string")


@pytest.mark.parametrize("hot", [False, True])
def test_equals_plain_joins(spark, hot):
    facts, people = tables(spark, hot)
    stored = CoPartitioned.build(facts, people, "k", 4, hot_share=10)
    assert (stored.hot_facts is not None) == hot
    names = ["k", "t", "name"]
    assert rows(stored.join(), *names) == rows(facts.join(people, "k"), *names)
    names = ["k", "name", "n", "last"]
    grouped = facts.groupBy("k").agg(*counts())
    for how in ("left", "inner"):
        assert rows(stored.attach(counts(), how), *names) == rows(people.join(grouped, "k", how), *names)
    stored.drop()


def test_nothing_is_moved(spark):
    facts, people = tables(spark)
    stored = CoPartitioned.build(facts, people, "k", 4, hot_share=10)
    joined = stored.join()
    for df in (joined, joined.groupBy("k").agg(*counts()), stored.attach(counts()), stored.attach(counts(), "inner")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_empty_tables(spark):
    facts, people = tables(spark)
    assert CoPartitioned.build(facts.limit(0), people, "k").attach(counts()).count() == 46
    assert CoPartitioned.build(facts, people.limit(0), "k").join().count() == 0
