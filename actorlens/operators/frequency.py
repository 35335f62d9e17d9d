"""Level frequencies, cumulative shares and vocabularies of categorical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actorlens.functions.expressions import negentropy
from actorlens.operators.joins import join_on
from actorlens.operators.ordering import BEFORE, SLICE_ROWS, ordered_index, running_before, with_slices
from actorlens.sources.storage import materialise


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per level, as (level, count)."""
    return df.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("count"))


def level_counts_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per level of several columns in one pass, as (column, level, count)."""
    long = df.select(*columns).unpivot([], columns, "column", "level")
    return long.dropna(subset=["level"]).groupBy("column", "level").agg(F.count("*").alias("count"))


def sorted_counts(counts: DataFrame, descending: bool = False) -> DataFrame:
    return counts.orderBy(F.desc("count") if descending else F.asc("count"), "level")


def cumulative_share(counts: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``rank``, ``cumulative`` and ``ratio`` over ascending count; ties go by MD5 of the level.

    Levels of one count form a class. A table of N rows has at most sqrt(2N) different counts, so
    the running total over the classes is small whatever N is; within a class every level weighs
    the same, so MD5 slices number its levels in parallel.
    """
    sliced = with_slices(counts, ["count"], "level", slice_rows)
    slices = sliced.groupBy("count", "_slice").agg(F.count("*").alias("_levels"))
    slices = slices.withColumn(
        "_offset",
        F.coalesce(
            F.sum("_levels").over(W.partitionBy("count").orderBy("_slice").rowsBetween(*BEFORE)),
            F.lit(0),
        ),
    )
    classes = slices.groupBy("count").agg(F.sum("_levels").alias("_class_levels"))
    ascending, everything = W.orderBy("count").rowsBetween(*BEFORE), W.partitionBy()
    weight = F.col("_class_levels") * F.col("count")
    classes = classes.select(
        "count",
        F.coalesce(F.sum("_class_levels").over(ascending), F.lit(0)).alias("_levels_before"),
        F.coalesce(F.sum(weight).over(ascending), F.lit(0)).alias("_rows_before"),
        F.sum(weight).over(everything).alias("_total"),
    )
    offsets = slices.drop("_levels").join(classes, "count")
    position = F.col("_offset") + F.row_number().over(
        W.partitionBy("count", "_slice").orderBy("_digest", "level")
    )
    return (
        sliced.join(offsets, ["count", "_slice"])
        .withColumn("_position", position)
        .select(
            "level",
            "count",
            (F.col("_levels_before") + F.col("_position")).alias("rank"),
            (F.col("_rows_before") + F.col("_position") * F.col("count")).alias("cumulative"),
            F.col("_total"),
        )
        .withColumn("ratio", F.col("cumulative") / F.col("_total"))
        .drop("_total")
    )


def first_rank_over(cumulative: DataFrame, share: float) -> DataFrame:
    """First rank at which the cumulative share exceeds ``share``."""
    return cumulative.filter(F.col("ratio") > share).agg(F.min("rank").alias("first_rank"))


def first_rank_with_count(counts: DataFrame, threshold: int) -> DataFrame:
    """First ascending rank whose count reaches ``threshold``; null if none does."""
    rarer = F.count_if(F.col("count") < threshold)
    return counts.agg(
        F.when(rarer < F.count("*"), rarer + 1).alias("first_rank"),
    )


def top_levels(counts: DataFrame, n: int = 99) -> DataFrame:
    """The n most frequent levels; ties go by level."""
    return sorted_counts(counts, descending=True).limit(n)


#: Cells that levels are hashed into; the summary of a table of any size has no more rows.
CELLS = 1 << 18


def cell_counts(df: DataFrame, column: str, cells: int = CELLS) -> DataFrame:
    """(cell, rows): how many rows have a level of each cell. Summaries of several tables merge by their sums.

    No level of a cell has more rows than the cell, which is what the summary tells for sure.
    """
    return df.groupBy(_cell(column, cells).alias("cell")).agg(F.count("*").alias("rows"))


def _cell(column: str, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(cells))


def _levels_in(df: DataFrame, column: str, chosen: DataFrame, cells: int) -> DataFrame:
    """Exact counts of the levels whose cells are chosen; the cells are few by their number alone."""
    rows = df.select(F.col(column).alias("level"), _cell(column, cells).alias("cell"))
    return level_counts(rows.join(F.broadcast(chosen.select("cell")), "cell", "left_semi"), "level")


def heavy_levels(df: DataFrame, column: str, n: int = 99, cells: int = CELLS) -> DataFrame:
    """``top_levels`` of the counts, without counting the many rare levels.

    The levels in the n largest cells are counted, and the n-th of these counts is one that the n-th
    level overall has at least. Cells with fewer rows in all cannot hold a top level, so only the
    levels of the others are counted: exactly, so the result is exact.
    """
    summary = materialise(cell_counts(df, column, cells))
    largest = summary.orderBy(F.desc("rows"), "cell").limit(n)
    sure = top_levels(_levels_in(df, column, largest, cells), n).agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
    least = sure["least"] if sure["n"] == n else 0
    return top_levels(_levels_in(df, column, summary.filter(F.col("rows") >= least), cells), n)


def frequent_levels(counts: DataFrame, threshold: int = 1000) -> DataFrame:
    """Levels that occur at least ``threshold`` times."""
    return counts.filter(F.col("count") >= threshold)


def sorted_levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null levels of a column in order."""
    return df.select(F.col(column).alias("level")).dropna().distinct().orderBy("level")


def factor_map(levels: DataFrame) -> DataFrame:
    """(level, idx) with idx 0..n-1 in level order, out of a table with distinct levels."""
    return ordered_index(levels.select("level"), "level").select(
        "level", F.col("idx").cast("double").alias("idx")
    )


def factor_maps(levels: DataFrame) -> DataFrame:
    """(column, level, idx) with idx 0..n-1 in level order within each column."""
    ones = levels.select("column", "level", F.lit(1).cast("bigint").alias("_one"))
    numbered = running_before(ones, ["level"], ["_one"], ["column"])
    return numbered.select("column", "level", F.col("before__one").cast("double").alias("idx"))


def out_of_fold(counts: DataFrame, keys: list[str], totals: list[str], folds: int) -> DataFrame:
    """Totals per keys over all folds but one, for each ``fold`` left out: what its training part knows.

    ``counts`` has (keys, fold, totals). One pass gives the totals, from which a fold's own are
    subtracted; no fold is counted again. A key is there for a fold only if others have rows of it.
    """
    whole = counts.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_all_{c}") for c in totals],
        # As many entries as there are folds at most.
        F.map_from_entries(F.collect_list(F.struct(F.col("fold"), F.struct(*totals)))).alias("_own"),
    )
    per_fold = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    own = F.try_element_at("_own", F.col("fold"))
    left = [(F.col(f"_all_{c}") - F.coalesce(own[c], F.lit(0))).alias(c) for c in totals]
    outside = per_fold.select("fold", *keys, *left)
    return outside.filter(sum((F.col(c) for c in totals), F.lit(0)) > 0)


def fold_vocabulary(levels: DataFrame) -> DataFrame:
    """(fold, column, level, idx) with idx 0..n-1 in level order within each fold and column."""
    ones = levels.select("fold", "column", "level", F.lit(1).cast("bigint").alias("_one"))
    numbered = running_before(ones, ["level"], ["_one"], ["fold", "column"])
    return numbered.select("fold", "column", "level", F.col("before__one").cast("double").alias("idx"))


def informative_by_fold(
    facts: DataFrame,
    folds: DataFrame,
    columns: list[str],
    entity: str,
    label: str,
    k: int,
    min_rows: int = 100,
    min_negentropy: float = -0.7,
) -> DataFrame:
    """(fold, column, level, humans, bots, negentropy): levels that tell something in each fold's training part.

    ``folds`` has (entity, label, fold). Facts shrink to one row per (entity, level) before they meet
    it. A level has at least one row of label 1, more than ``min_rows`` in all and a clear enough share.
    """
    long = facts.select(entity, *columns).unpivot(entity, columns, "column", "level")
    pairs = long.dropna(subset=["level"]).groupBy(entity, "column", "level").agg(F.count("*").alias("_rows"))
    met = pairs.join(folds.select(entity, label, "fold"), entity)
    counts = met.groupBy("column", "level", "fold").agg(
        F.sum(F.when(F.col(label) == 0, F.col("_rows")).otherwise(0)).alias("humans"),
        F.sum(F.when(F.col(label) == 1, F.col("_rows")).otherwise(0)).alias("bots"),
    )
    outside = out_of_fold(counts, ["column", "level"], ["humans", "bots"], k)
    scored = outside.withColumn("negentropy", negentropy(F.col("bots"), F.col("humans") + F.col("bots")))
    return scored.filter(
        (F.col("bots") >= 1) & (F.col("humans") + F.col("bots") > min_rows) & (F.col("negentropy") > min_negentropy)
    )


def share_of_rows(counts: DataFrame, selected: DataFrame) -> DataFrame:
    """Share of all rows that a selection of levels covers."""
    marked = join_on(counts, selected.select("level").withColumn("_in", F.lit(1)), ["level"], "left")
    covered = F.sum(F.when(F.col("_in") == 1, F.col("count")).otherwise(0))
    return marked.agg((covered / F.sum("count")).alias("share"))
