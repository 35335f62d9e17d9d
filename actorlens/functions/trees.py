"""Fitted linear models and trees as plain expressions, to recompute what a model says."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LinearSVCModel, RandomForestClassificationModel
from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_margin(model: LinearSVCModel, features: Column) -> Column:
    """Dot product of a vector column with the coefficients, plus the intercept; of a sparse vector only the entries it holds."""
    vector = F.unwrap_udt(features)
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    coefficients = F.array(*[F.lit(float(c)) for c in model.coefficients])
    products = F.zip_with(places, vector["values"], lambda i, x: x * F.get(coefficients, i))
    return F.aggregate(products, F.lit(float(model.intercept)), lambda a, x: a + x)


def _leaf_share(node, features: Column) -> Column:
    """Share of class 1 in the leaf that an array column falls into."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return F.lit(stats[1] / sum(stats))
    split = node.split()
    value = F.get(features, F.lit(split.featureIndex()))
    if split.getClass().getSimpleName() == "ContinuousSplit":
        left = value <= F.lit(split.threshold())
    else:
        left = value.isin([float(c) for c in split.leftCategories()])
    return F.when(left, _leaf_share(node.leftChild(), features)).otherwise(_leaf_share(node.rightChild(), features))


def forest_probability(model: RandomForestClassificationModel, features: Column) -> Column:
    """Mean over the trees of the share of class 1 in the leaf."""
    shares = [_leaf_share(tree._java_obj.rootNode(), features) for tree in model.trees]
    return reduce(lambda a, b: a + b, shares) / len(shares)
