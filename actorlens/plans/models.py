"""Training, scoring, cross-validation and submission jobs on the joined bid table.

The model sees bids, the metric judges bidders: predictions are rolled up to one score per
bidder before the area under the curve is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from actorlens.functions.parallel import run_jobs
from actorlens.operators import metrics, sampling
from actorlens.operators.encoding import Vocabulary, encoding_stages, feature_columns, indexed, labelled
from actorlens.operators.joins import join_entities_to_facts
from actorlens.plans.bindings import DROPPED
from actorlens.sources import delimited
from actorlens.sources.storage import (
    checkpointed,
    load_model,
    materialise,
    release,
    save_model,
    scratch_path,
)

#: Makes an estimator for vocabularies of these sizes.
ModelMaker = Callable[[dict[str, int]], Estimator]
Augment = Callable[[DataFrame], DataFrame]

# The forest and SVM settings that results are compared under.
FOREST = {"numTrees": 50, "maxDepth": 4, "impurity": "gini", "featureSubsetStrategy": "auto"}
MIN_BINS = 100
SVM_ITERATIONS = 100
SVM_REGULARISATION = 0.01


def random_forest(sizes: dict[str, int], seed: int = 11, **settings) -> Estimator:
    """A forest with a bin for every level and the unknown one."""
    bins = max([MIN_BINS, *[size + 1 for size in sizes.values()]])
    return RandomForestClassifier(**{**FOREST, "maxBins": bins, "seed": seed, **settings})


def linear_svm(sizes: dict[str, int], **settings) -> Estimator:
    """A linear SVM through the origin; features are standardised, as raw ticks are among them."""
    return LinearSVC(
        **{
            "maxIter": SVM_ITERATIONS,
            "regParam": SVM_REGULARISATION,
            "fitIntercept": False,
            "standardization": True,
            **settings,
        }
    )


#: Rows of a partition of the fit, and of the partitions beyond MANY_PARTITIONS.
FIT_PARTITION_ROWS, LARGE_PARTITION_ROWS = 25_000, 1_000_000
MANY_PARTITIONS = 47
#: Bids up to which folds are validated side by side. Fits hold their rows while they pass over them; those of several large folds would drive each other out of memory.
SIDE_BY_SIDE_ROWS = 10_000_000
#: Bidders of a fold that are broadcast to its bids. A join of more moves the bids, which are then laid out anew once a fold.
BROADCAST_BIDDERS = 100_000


def fit_partitions(rows: int) -> int:
    """Partitions of the training rows: their number follows from the rows, not from the cluster.

    An SVM passes over them a hundred times and more, with a task per partition that reports to the driver.
    """
    return max(min(rows // FIT_PARTITION_ROWS, MANY_PARTITIONS), rows // LARGE_PARTITION_ROWS) + 1


def folds_at_a_time(rows: int, parallelism: int) -> int:
    return parallelism if rows <= SIDE_BY_SIDE_ROWS else 1


def train(
    joined: DataFrame,
    vocabulary: Vocabulary,
    model_maker: ModelMaker,
    one_hot: bool,
    dropped: Iterable[str] = DROPPED,
    augment: Augment | None = None,
    balanced: bool = False,
    key: str = "bid_id",
    laid_out: bool = False,
    partitions: int | None = None,
) -> PipelineModel:
    """Fit on the rows of bidders joined with bids: encoding and model in one pipeline model.

    Training passes over its input several times, so the rows are laid out once by ``key`` in partitions
    whose number follows from the rows (``partitions`` sets it), and kept on disk until the fit is done;
    a model does not depend on the cores. Rows move with their columns and are encoded where they come to
    lie, as vectors are wider. Bids that are ``laid_out`` already are neither kept nor moved: every pass
    joins and encodes them where they are. ``augment`` may change the rows (key, label, features) before,
    such as oversample a rare label; ``balanced`` weighs the rows so that both labels count alike.
    """
    spark = joined.sparkSession
    columns = feature_columns(joined, vocabulary.sizes, {*dropped, "outcome"})
    inputs = [f"{c}_idx" if c in vocabulary.sizes else c for c in columns]
    rows, path = indexed(joined, vocabulary).select(key, "outcome", *inputs), None
    encoder = Pipeline(stages=encoding_stages(columns, vocabulary.sizes, one_hot)).fit(rows)

    def encoded(df: DataFrame) -> DataFrame:
        return labelled(encoder.transform(df), "outcome").select(key, "label", "features")

    if augment:
        rows = augment(encoded(rows))
        if not laid_out:
            path = scratch_path(spark, "training-rows")
            rows = materialise(rows, path)
    labels = rows.select("label") if augment else joined.select(F.col("outcome").cast("double").alias("label"))
    totals = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())
    if not laid_out:
        rows = rows.repartition(partitions or fit_partitions(n), key).sortWithinPartitions(key, "label" if augment else "outcome")
    if not augment:
        rows = encoded(rows)
    # On disk, as a fit holds its own form of the rows in memory.
    kept = rows = rows if laid_out else rows.persist(StorageLevel.DISK_ONLY)
    estimator = model_maker(vocabulary.sizes)
    if balanced and len(totals) > 1:
        weights = [F.when(F.col("label") == label, n / len(totals) / rows_of) for label, rows_of in totals.items()]
        rows = rows.withColumn("weight", F.coalesce(*weights))
        estimator = estimator.copy({estimator.getParam("weightCol"): "weight"})
    model = estimator.fit(rows)
    if not laid_out:
        kept.unpersist()
    if path:
        release(spark, path)
    return PipelineModel(stages=[*encoder.stages, model])


def score_rows(
    joined: DataFrame, model: PipelineModel, keys: Iterable[str], vocabulary: Vocabulary
) -> DataFrame:
    """Keys with the predicted class as ``pred`` and the strength of class 1 as ``p1``.

    ``p1`` is the class probability, or the margin of a model that has none.
    """
    scored = model.transform(indexed(joined, vocabulary))
    strength = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select(
        *keys, F.col("prediction").alias("pred"), vector_to_array(strength)[1].alias("p1")
    )


def cross_validate(
    bids: DataFrame,
    folds: DataFrame,
    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    vocabulary: Vocabulary,
    model_maker: ModelMaker,
    pairs: int,
    one_hot: bool = True,
    result_dir: str | None = None,
    parallelism: int = 4,
    augment: Augment | None = None,
    balanced: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Area under the curve per fold, and the score of every validated bidder.

    ``auc`` ranks bidders by their share of rows predicted 1, ``auc_by_strength`` by the mean
    strength of class 1, which still ranks them where no row crosses the threshold.

    ``folds`` holds the bidders with a ``fold`` column; the first ``pairs`` folds are validated.
    ``prepare`` maps the raw (train, validation) bidders of a fold to model-ready ones, fitted on
    the first only. The bids meet their levels' indices and are laid out for training once for all
    folds; a fold is the bidders that mask them, and rewrites no bid unless its bidders are too many to
    be broadcast. Scored rows of a fold are written once and read back for the metric; with
    ``result_dir`` they stay there as text, one folder per fold.
    """
    spark = bids.sparkSession
    scored_dir = scratch_path(spark, "cv-scored")
    n = bids.count()
    used = bids.drop(*{*DROPPED} - {"bid_id", "bidder_id"})
    placed = indexed(used, vocabulary).repartition(fit_partitions(n), "bid_id")
    # A checkpoint, as its partitions and their order stay as they are.
    facts = checkpointed(placed.sortWithinPartitions("bid_id"))

    def validate(fold: int) -> DataFrame:
        train_bidders, validation_bidders = map(materialise, prepare(*sampling.fold_pair(folds, fold)))
        few = train_bidders.count() <= BROADCAST_BIDDERS
        model = train(
            join_entities_to_facts(F.broadcast(train_bidders) if few else train_bidders, facts, "bidder_id"),
            vocabulary,
            model_maker,
            one_hot,
            augment=augment,
            balanced=balanced,
            laid_out=few,
            partitions=fit_partitions(n),
        )
        joined = join_entities_to_facts(validation_bidders, facts, "bidder_id")
        scored = score_rows(joined, model, ["bid_id", "bidder_id", "outcome"], vocabulary)
        stored = materialise(scored, f"{scored_dir}/result_{fold}").withColumn("fold", F.lit(fold))
        if result_dir:
            delimited.write_scored(stored.drop("fold"), f"{result_dir}/result_{fold}")
        return stored

    scored = reduce(DataFrame.unionByName, run_jobs(spark, validate, range(pairs), folds_at_a_time(n, parallelism)))
    bidders = checkpointed(
        metrics.entity_scores(scored, "bidder_id", groups=["fold"], probability="p1")
    )
    release(spark, scored_dir)
    by_share = metrics.area_under_roc(bidders, groups=["fold"])
    by_strength = metrics.area_under_roc(bidders, "mean_probability", groups=["fold"])
    areas = by_share.join(
        by_strength.select("fold", F.col("auc").alias("auc_by_strength")), "fold"
    )
    return areas, bidders


def train_job(
    bids: DataFrame,
    bidders: DataFrame,
    vocabulary: Vocabulary,
    model_maker: ModelMaker,
    one_hot: bool,
    model_path: str,
    balanced: bool = False,
) -> None:
    """Fit on all labelled bidders; save the pipeline, and the factor maps beside it."""
    joined = join_entities_to_facts(bidders, bids, "bidder_id")
    save_model(train(joined, vocabulary, model_maker, one_hot, balanced=balanced), f"{model_path}/pipeline")
    vocabulary.maps.select("column", "level", "idx").write.mode("overwrite").parquet(f"{model_path}/factor-maps")
    sizes = bids.sparkSession.createDataFrame(list(vocabulary.sizes.items()), "column string, size bigint")
    sizes.write.mode("overwrite").parquet(f"{model_path}/sizes")


def saved_vocabulary(bids: DataFrame, model_path: str) -> Vocabulary:
    read = bids.sparkSession.read
    sizes = {r["column"]: r["size"] for r in read.parquet(f"{model_path}/sizes").collect()}
    schema = "column string, level string, idx double"
    return Vocabulary(read.schema(schema).parquet(f"{model_path}/factor-maps"), sizes)


def submission_job(
    bids: DataFrame, bidders: DataFrame, model_path: str, output_path: str | None = None, strength: bool = False
) -> DataFrame:
    """Score bidders with a saved model: (bidder_id, prob), one row per bidder with bids.

    With ``strength`` the mean strength of class 1 follows as ``mean_probability``. Row scores are
    written before the roll-up: grouping straight behind a join on the same key would tie all rows
    of a bidder to one task, and the adaptive skew join could not split them.
    """
    joined = join_entities_to_facts(bidders.drop("outcome"), bids, "bidder_id")
    model, vocabulary = load_model(f"{model_path}/pipeline"), saved_vocabulary(bids, model_path)
    rows = materialise(score_rows(joined, model, ["bidder_id"], vocabulary))
    scores = metrics.entity_scores(rows, "bidder_id", label=None, probability="p1")
    if output_path:
        delimited.write_submission(scores.select("bidder_id", "prob"), output_path)
    return scores if strength else scores.select("bidder_id", "prob")


def cross_validated_accuracy(
    df: DataFrame,
    key: str,
    label: str,
    features: list[str],
    estimator: Estimator,
    k: int = 10,
    label_levels: list[str] | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Accuracy per fold of any classifier on a table with numeric features."""
    spark = df.sparkSession
    folds = sampling.plain_folds(labelled(df, label, label_levels).select(key, "label", *features), key, k)
    folds = materialise(folds)
    pipeline = Pipeline(stages=[*encoding_stages(features, {}), estimator])
    path = scratch_path(spark, "accuracy")

    def validate(fold: int) -> DataFrame:
        train_rows, validation_rows = sampling.fold_pair(folds, fold)
        predicted = pipeline.fit(train_rows).transform(validation_rows)
        scored = materialise(predicted.select(key, "label", "prediction"), f"{path}/fold_{fold}")
        return scored.withColumn("fold", F.lit(fold))

    scored = sampling.union_all(run_jobs(spark, validate, range(k), parallelism))
    return metrics.accuracy(scored, "label", "prediction", ["fold"])
