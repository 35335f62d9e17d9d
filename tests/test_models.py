import random

import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from actorlens.functions import trees
from actorlens.operators import encoding, metrics, sampling
from actorlens.plans import features, models
from actorlens.sources import storage
from tests.conftest import rows

LEVELS = {
    "merchandise": ["auto", "home"],
    "device": ["d0", "d1", "d2"],
    "country": ["at", "in"],
    "url": ["u0", "u1"],
}


@pytest.fixture(scope="module")
def auction(spark):
    """Bots react fast and use few devices; humans are slow and use many."""
    rng = random.Random(1)
    people = [(f"p{i:03d}", f"acc{i % 3}", f"addr{i}", int(i % 4 == 0)) for i in range(60)]
    bids, bid_id = [], 0
    for key, _, _, bot in people[:56]:
        t = rng.randrange(1_000)
        for _ in range(rng.randrange(8, 16)):
            t += rng.randrange(1, 20) if bot else rng.randrange(50, 2_000)
            device = "d0" if bot else rng.choice(["d0", "d1", "d2", "rare"])
            bids.append(
                (bid_id, key, rng.randrange(20), rng.choice(["auto", "home"]), device, t,
                 rng.choice(["at", "in", "xx"]), f"ip{rng.randrange(30)}", rng.choice(["u0", "u1", "u9"]))
            )
            bid_id += 1
    bids.append((bid_id, "stranger", 1, "auto", "d0", 5, "at", "ip1", "u0"))
    return (
        storage.checkpointed(spark.createDataFrame(
            bids,
            "bid_id bigint, bidder_id string, auction int, merchandise string, device string,"
            " time bigint, country string, ip string, url string",
        )),
        spark.createDataFrame(people, "bidder_id string, payment_account string, address string, outcome int"),
    )


@pytest.fixture(scope="module")
def words(spark):
    return encoding.from_lists(spark, LEVELS)


@pytest.fixture(scope="module")
def prepared(auction):
    bids, people = auction
    per_bidder = storage.checkpointed(features.per_bidder(bids, cutoff=1_500))
    known = features.labelled_bidders(people, per_bidder)
    everyone = features.bidders_to_score(people.drop("outcome"), per_bidder)
    return bids, storage.checkpointed(known), everyone


def prepare(train, validation):
    return features.imputed_pair(train, validation)[:2]


@pytest.mark.parametrize(
    "maker, one_hot", [(models.random_forest, False), (models.linear_svm, True)]
)
def test_cross_validation_ranks_bots_first(prepared, words, spark, tmp_path, maker, one_hot):
    bids, known, _ = prepared
    folds = storage.checkpointed(sampling.stratified_folds(known, "bidder_id", "outcome", 4))
    areas, scores = models.cross_validate(
        bids, folds, prepare, words, maker, 2, one_hot, str(tmp_path / "cv")
    )
    assert rows(areas, "fold") == [(0,), (1,)]
    assert metrics.mean_and_sd(areas, "auc_by_strength").first()["avg"] > 0.9
    validated = folds.filter("fold < 2").select("fold", "bidder_id")
    assert rows(scores, "fold", "bidder_id") == rows(validated, "fold", "bidder_id")
    lines = [tuple(r["value"].split(",")) for r in spark.read.text(str(tmp_path / "cv" / "result_0")).collect()]
    known_bids = bids.join(folds.filter("fold = 0"), "bidder_id").select("bid_id", "bidder_id", "outcome")
    assert sorted(line[:3] for line in lines) == sorted(tuple(map(str, r)) for r in known_bids.collect())


def test_any_estimator_fits_in(prepared, words):
    bids, known, _ = prepared
    folds = storage.checkpointed(sampling.stratified_folds(known, "bidder_id", "outcome", 3))
    areas, _ = models.cross_validate(
        bids, folds, prepare, words, lambda _: LogisticRegression(maxIter=10), 1
    )
    assert areas.first()["auc_by_strength"] > 0.8


def test_oversampling_the_training_rows_lifts_the_share(prepared, words):
    bids, known, _ = prepared
    folds = storage.checkpointed(sampling.stratified_folds(known, "bidder_id", "outcome", 3))

    def balance(rows):
        return sampling.replicate(rows, "label", 1.0, 20)

    shares = []
    for augment in (None, balance):
        _, scores = models.cross_validate(
            bids, folds, prepare, words, models.random_forest, 1, False, augment=augment
        )
        shares.append(scores.agg(F.avg("prob")).first()[0])
    assert shares[0] <= shares[1]


@pytest.mark.parametrize(
    "maker, one_hot", [(models.random_forest, False), (models.linear_svm, True)]
)
def test_train_then_submit(spark, prepared, words, tmp_path, maker, one_hot):
    bids, known, everyone = prepared
    train, to_score, _ = features.imputed_pair(known, everyone)
    model, output = str(tmp_path / "model"), str(tmp_path / "out")
    models.train_job(bids, train, words, maker, one_hot, model)
    scores = models.submission_job(bids, to_score, model, output)
    assert scores.columns == ["bidder_id", "prob"]
    # One row per bidder with bids: the four idle ones have none.
    assert scores.count() == 56
    assert scores.filter("prob < 0 or prob > 1").isEmpty()
    assert spark.read.text(output).count() == 56
    labelled = scores.join(known.select("bidder_id", "outcome"), "bidder_id")
    assert metrics.area_under_roc(labelled).first()["auc"] > 0.8


def test_validation_rows_do_not_reach_the_imputer(prepared):
    _, known, _ = prepared
    train, validation = sampling.fold_pair(
        sampling.stratified_folds(known, "bidder_id", "outcome", 4), 0
    )
    _, _, imputer = features.imputed_pair(train, validation)
    assert imputer.means["bids"] == pytest.approx(train.agg(F.avg("bids")).first()[0])
    donors = {r[0] for r in imputer.donors.select("bidder_id").collect()}
    assert donors <= {r[0] for r in train.select("bidder_id").collect()}


def test_forest_has_bins_for_every_level():
    forest = models.random_forest({"url": 250})
    assert forest.getMaxBins() == 251
    assert models.random_forest({"url": 3}).getMaxBins() == 100


def test_multiclass_accuracy(spark):
    rng = random.Random(8)
    names = ["setosa", "versicolor", "virginica"]
    data = [
        (i, names[i % 3], *[rng.gauss(3 * (i % 3) + j, 0.6) for j in range(4)]) for i in range(150)
    ]
    df = spark.createDataFrame(data, "id bigint, kind string, a double, b double, c double, d double")
    forest = RandomForestClassifier(numTrees=10, maxDepth=4, maxBins=100, seed=11)
    per_fold = models.cross_validated_accuracy(df, "id", "kind", list("abcd"), forest, 10, names)
    assert per_fold.count() == 10
    assert per_fold.agg(F.sum("rows")).first()[0] == 150
    assert metrics.mean_and_sd(per_fold, "accuracy").first()["avg"] > 0.9


def _rare_bots(spark):
    """One bidder in twenty is a bot; its device tells, but not always."""
    rng = random.Random(21)
    people = [(f"p{i:03d}", "acc", "addr", int(i % 20 == 0)) for i in range(300)]
    bids = []
    for key, _, _, bot in people:
        for _ in range(10):
            device = "d0" if rng.random() < (0.6 if bot else 0.1) else rng.choice(["d1", "d2"])
            bids.append((len(bids), key, 1, "auto", device, rng.randrange(10_000), "at", "ip", "u0"))
    return (
        spark.createDataFrame(
            bids,
            "bid_id bigint, bidder_id string, auction int, merchandise string, device string,"
            " time bigint, country string, ip string, url string",
        ),
        spark.createDataFrame(people, "bidder_id string, payment_account string, address string, outcome int"),
    )


@pytest.mark.parametrize("maker, one_hot", [(models.random_forest, False), (models.linear_svm, True)])
def test_balanced_models_find_rare_bots(spark, words, tmp_path, maker, one_hot):
    bids, people = _rare_bots(spark)
    model = str(tmp_path / "model")
    models.train_job(bids, people, words, maker, one_hot, model, balanced=True)
    scores = models.submission_job(bids, people, model, strength=True)
    assert scores.select("prob").distinct().count() > 3
    labelled = scores.join(people.select("bidder_id", "outcome"), "bidder_id")
    for score in ("prob", "mean_probability"):
        assert metrics.area_under_roc(labelled, score).first()["auc"] > 0.8


def test_forest_does_not_depend_on_the_layout(spark, words):
    bids, people = _rare_bots(spark)
    joined = people.withColumnRenamed("bidder_id", "bidder_id_left").join(bids, F.col("bidder_id_left") == F.col("bidder_id"))
    dropped = [*models.DROPPED, "bidder_id_left"]
    texts = {
        models.train(joined.repartition(n), words, models.random_forest, False, dropped).stages[-1].toDebugString.split("\n", 1)[1]
        for n in (1, 3, 11)
    }
    assert len(texts) == 1


def test_partitions_and_folds_of_large_fits_are_few():
    assert [models.fit_partitions(n) for n in (0, 100_000, 6_000_000, 36_000_000, 90_000_000)] == [1, 5, 48, 48, 91]
    assert models.folds_at_a_time(1_000_000, 4) == 4 and models.folds_at_a_time(36_000_000, 4) == 1


def test_a_fold_of_many_bidders_is_laid_out_as_one_of_few(prepared, words, monkeypatch):
    bids, known, _ = prepared
    folds = storage.checkpointed(sampling.stratified_folds(known, "bidder_id", "outcome", 3))
    found = []
    for most in (100, 0):
        monkeypatch.setattr(models, "BROADCAST_BIDDERS", most)
        monkeypatch.setattr(models, "fit_partitions", lambda n: 3)
        areas, scores = models.cross_validate(bids, folds, prepare, words, models.random_forest, 1, False)
        found.append((rows(areas, *areas.columns), rows(scores, "bidder_id", "prob", "mean_probability")))
    assert found[0] == found[1]


def test_training_rows_move_as_columns_and_are_let_go(spark, words, monkeypatch):
    bids, people = _rare_bots(spark)
    moved = []
    repartition = type(bids).repartition
    monkeypatch.setattr(type(bids), "repartition", lambda df, *to: moved.append(df.columns) or repartition(df, *to))
    model = models.train(people.withColumnRenamed("bidder_id", "bidder_id_left").join(bids, F.col("bidder_id_left") == F.col("bidder_id")), words, models.linear_svm, True)
    assert len(model.stages[-1].coefficients) == 10
    assert moved == [["bid_id", "outcome", "merchandise_idx", "device_idx", "time", "country_idx", "url_idx"]]
    assert not list(spark.sparkContext._jsc.getPersistentRDDs())


@pytest.mark.parametrize("dense", [False, True])
def test_margin_from_the_entries_of_a_vector(spark, dense):
    class Model:
        coefficients, intercept = [2.0, -1.0, 4.0], 0.5

    vector = Vectors.dense([3.0, 0.0, 0.25]) if dense else Vectors.sparse(3, {0: 3.0, 2: 0.25})
    found = spark.createDataFrame([(vector,)], ["features"]).select(trees.linear_margin(Model, F.col("features")))
    assert found.first()[0] == 7.5
