import pytest
from pyspark.sql import functions as F

from actorlens.operators import sampling
from tests.conftest import rows


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(237).select("id", (F.col("id") % 9 == 0).cast("int").alias("y"))


def test_split_is_stratified_disjoint_and_complete(people):
    split = sampling.stratified_split(people, "id", "y")
    train, rest = sampling.train_part(split), sampling.test_part(split)
    assert sorted(rows(train) + rows(rest), key=repr) == rows(people)
    for label in (0, 1):
        n = people.filter(F.col("y") == label).count()
        assert train.filter(F.col("y") == label).count() == n * 8 // 10


def test_split_does_not_depend_on_layout(people):
    again = sampling.stratified_split(people.repartition(7).orderBy(F.desc("id")), "id", "y")
    assert rows(again) == rows(sampling.stratified_split(people, "id", "y"))


def test_folds_are_even_within_labels(people):
    folds = sampling.stratified_folds(people, "id", "y", 10)
    assert folds.count() == 237
    sizes = folds.groupBy("y", "fold").count().collect()
    for label in (0, 1):
        of_label = [r["count"] for r in sizes if r["y"] == label]
        assert len(of_label) == 10 and max(of_label) - min(of_label) <= 1
    train, valid = sampling.fold_pair(folds, 3)
    assert train.count() + valid.count() == 237
    assert train.join(valid, "id").isEmpty()


def test_plain_folds(people):
    sizes = sampling.plain_folds(people, "id", 10).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [23] * 3 + [24] * 7


def test_oversampling_draws_differ_and_hold_one_label(people):
    one = sampling.oversample(people, "y", 1, 1)
    drawn = sampling.oversample(people, "y", 1, 3)
    assert drawn.filter("y = 0").isEmpty()
    assert rows(drawn) != sorted(rows(one) * 3, key=repr)
    assert rows(drawn) == rows(sampling.oversample(people, "y", 1, 3))
    both = sampling.oversample(people, "y", 1, 2, include_original=True)
    assert both.filter("y = 0").count() == people.filter("y = 0").count()
    assert sampling.oversample(people, "y", 1, 0).isEmpty()


def test_replication_is_exact(people):
    copied = sampling.replicate(people, "y", 1, 4)
    minority = people.filter("y = 1").count()
    assert copied.count() == people.count() + 4 * minority
    only = sampling.replicate(people, "y", 1, 4, include_original=False)
    assert only.count() == 4 * minority
