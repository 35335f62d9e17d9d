"""A training-data pipeline of five stages, each over all that its predecessor kept.

1. ``quality``: positive-unlabelled classifier; documents scored below 0.7 go.
2. ``lines``: lines that documents share stay in the first of them only; documents that lose all
   their words by that go.
3. ``near_copies``: documents that share 80 percent of their five-word shingles are linked; of each
   group of linked documents the one with the smallest doc_id stays.
4. ``mix``: documents are repeated or left out, so that the sources meet their target weights.
5. ``tokens``: byte-level BPE ids of every remaining document, and the digest of the bytes they decode to.

All stages but the last return the columns of ``documents``. Null and empty texts pass like others;
rows that repeat a doc_id pass stages 1 and 2 each, share their decision in stage 3 and are
repeated alike in stage 4; columns beside those of ``documents`` go in
the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actorlens.llm import bpe, jaccard, line_dedup, mixing, quality
from actorlens.sources.storage import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.7

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from labels outside the held-out fold; keep what the model scores 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = ~quality.held_out()
    model = quality.train(docs, labels.filter((F.col("quality") == 1) & learned), learned)
    scored = model.score(docs, carry=("text", "lang", "source", "n_chars"))
    return scored.filter(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = line_dedup.LineIndex.create(spark).insert(docs)
    kept = index.kept(docs, carry=("lang", "source"))
    # A document all of whose lines others hold is a copy of them; one that was blank before stays.
    emptied = (F.col("n_dropped") > 0) & F.col("kept").rlike(r"\A[\x20\x09-\x0D]*\z")
    return kept.filter(~emptied).select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("bigint").alias("n_chars")
    )


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.near_components(docs, width=5, percent=80)
    # A document without a key is in no group, so it stays.
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    copies = mixed.agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    same = (
        F.col("doc_id").eqNullSafe(F.col("_doc"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (mixing.word_count() == F.col("_size"))
    )
    repeated = docs.join(copies, same).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_copies", near_copies_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: The classifier and the balancing iterate, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
