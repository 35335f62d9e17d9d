"""Entity scores from row predictions, and what they are judged by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actorlens.functions.expressions import share
from actorlens.operators.ordering import running_before


def entity_scores(
    scored: DataFrame,
    entity: str,
    prediction: str = "pred",
    label: str | None = "outcome",
    groups: list[str] | None = None,
    probability: str | None = None,
) -> DataFrame:
    """Share of an entity's rows predicted 1 as ``prob``, with the entity's label if it has one.

    ``probability`` adds the mean row probability as ``mean_probability``, a second score for
    models that rarely cross the threshold.
    """
    outputs = [share(F.col(prediction) == 1).alias("prob")]
    if label:
        outputs.append(F.max(label).alias(label))
    if probability:
        outputs.append(F.avg(probability).alias("mean_probability"))
    return scored.groupBy(*(groups or []), entity).agg(*outputs)


def with_default_score(entities: DataFrame, scores: DataFrame, entity: str, default: float) -> DataFrame:
    """A score for every entity, ``default`` for those without rows."""
    joined = entities.select(entity).join(scores.select(entity, "prob"), entity, "left")
    return joined.fillna({"prob": default})


def area_under_roc(
    scored: DataFrame, score: str = "prob", label: str = "outcome", groups: list[str] | None = None
) -> DataFrame:
    """Exact area under the ROC curve per group, with its bounds over the orders of tied scores.

    ``auc_low`` ranks the negatives of a tie first, ``auc_high`` the positives; ``auc`` is the
    middle, which is the trapezoid area. Null where a label is missing.
    """
    groups = groups or []
    ties = scored.groupBy(*groups, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    ranked = running_before(ties, [score], ["pos"], groups, descending=True)
    above, pos, neg = (F.col(c).cast("double") for c in ("before_pos", "pos", "neg"))
    pairs = F.nullif(F.sum(pos) * F.sum(neg), F.lit(0.0))
    low = F.sum(neg * above) / pairs
    high = F.sum(neg * (above + pos)) / pairs
    return ranked.groupBy(*groups).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        low.alias("auc_low"),
        high.alias("auc_high"),
        ((low + high) / 2).alias("auc"),
    )


def mean_and_sd(values: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Mean and sample sd of a per-fold value; the sd of one fold is null."""
    return values.groupBy(*(groups or [])).agg(
        F.count(value).alias("folds"),
        F.avg(value).alias("avg"),
        F.stddev_samp(value).alias("sd"),
    )


def accuracy(
    scored: DataFrame, label: str, prediction: str, groups: list[str] | None = None, rows: str | None = None
) -> DataFrame:
    """Rows and share of rows predicted right; ``rows`` names a column that counts equal rows."""
    weight = F.col(rows) if rows else F.lit(1)
    right = F.when(F.col(label) == F.col(prediction), weight).otherwise(0)
    return scored.groupBy(*(groups or [])).agg(
        F.sum(weight).alias("rows"), (F.sum(right) / F.sum(weight)).alias("accuracy")
    )
