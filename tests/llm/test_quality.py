import random

import numpy as np
from pyspark.sql import functions as F

from actorlens.llm import quality
from actorlens.llm.queries import QUERIES
from tests.llm.helpers import documents, empty_documents


def _clean(draw):
    words = ["the", "river", "and", "stone", "walks", "over", "green", "hills", "with", "quiet", "steps", "today"]
    return " ".join(draw.choice(words) + draw.choice(["", "", "s", "ed"]) for _ in range(draw.randint(40, 90))) + "."


def _junk(draw):
    return " ".join(draw.choice(["BUY", "NOW", "CLICK", "WIN"]) + "!!" for _ in range(draw.randint(40, 90)))


def test_learns_from_positives_and_unlabelled_only(spark):
    draw = random.Random(3)
    good = [draw.random() < 0.7 for _ in range(1200)]
    docs = documents(spark, [_clean(draw) if g else _junk(draw) for g in good])
    positives = spark.createDataFrame([(i,) for i, g in enumerate(good) if g and i % 3 == 0], "doc_id bigint")
    model = quality.train(docs, positives)
    assert abs(model.prior - 0.7) < 0.08
    scores = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    assert np.mean([(scores[i] >= 0.5) == g for i, g in enumerate(good)]) > 0.98
    # The same once more.
    assert quality.train(docs, positives) == model


def test_small_and_odd_tables(spark):
    odd = documents(spark, [None, "", "word", "word", "y" * 100_000, " \n "], extra=True)
    none = spark.createDataFrame([], "doc_id bigint")
    model = quality.train(odd, none)
    assert {r["score"] for r in model.score(odd).collect()} == {0.5}
    model = quality.train(odd, spark.createDataFrame([(2,), (None,), (2,)], "doc_id bigint"))
    scores = {r["doc_id"]: r["score"] for r in model.score(odd).collect()}
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores.values()) and scores[2] == scores[3]
    assert scores[0] == scores[1]
    assert quality.train(empty_documents(spark), none).score(empty_documents(spark)).count() == 0


def test_query_on_the_held_out_fold(spark, data_dir):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet").select("doc_id", "quality")
    scored = QUERIES["op1_quality_classifier"](spark, data_dir)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert scored.count() == spark.read.parquet(f"{data_dir}/documents.parquet").count()
    assert scored.filter((F.col("score") >= 0.7) != (F.col("predicted") == 1)).count() == 0
