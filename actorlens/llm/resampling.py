"""Importance resampling towards a target distribution, and an exact draw of the best keys.

Features of a text are its words and pairs of neighbouring words, hashed into a fixed number of
buckets. Bucket counts of the corpus and of the target texts, added up over all rows, give every
bucket a gain; the array of gains scores each document in one pass. The draw adds noise fixed by the
key, and takes the highest scores.

The cut-off is found without sorting the table. Every partition tells the median of its remaining
keys and how many these are. The median of the medians, weighted by those sizes, has at least a
quarter of the remaining keys on either side, so each round discards at least a quarter for sure,
until few are left to read off the exact key. Only the winners are sorted.

Defined cases: a null or empty text has no words, no features and weight 0; rows that repeat are
scored each and compete each, as if they were different documents with equal scores; a null key
draws the noise of the empty key and loses ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema, id_and_text, key_type, pieces
from actorlens.operators.ordering import running_before
from actorlens.sources.storage import materialise

BUCKETS = 10_000
#: Words of UTF-8 bytes whose A-Z are lower-case already.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Remaining keys that are read off instead of being cut further.
FEW = 4096


def feature_buckets(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each word and each pair of neighbours."""
    words = WORD.findall(text.encode().lower())
    n = len(words)
    if not n:
        return 0, np.empty(0, np.int64)
    hashes = np.empty(2 * n - 1, np.int64)
    singles = list(map(zlib.crc32, words))
    hashes[:n] = singles
    # The checksum of "a b" goes on from the one of "a".
    hashes[n:] = list(map(zlib.crc32, [b" " + w for w in words[1:]], singles))
    return n, hashes % buckets


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; every batch is added up before it leaves its task."""
    target = arrow_schema("bucket int, features bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            for value in batch.column(1).to_pylist():
                sums += np.bincount(feature_buckets(value, buckets)[1], minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], schema=target)

    rows = id_and_text(texts.select(F.lit(0).alias("key"), F.col(text).alias("t")), "key", "t")
    totals = rows.mapInArrow(count, "bucket int, features bigint").groupBy("bucket").agg(F.sum("features").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in totals.collect():  # one row per bucket at most
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of a bucket's share in the target over its share in the corpus, with one more in each bucket."""
    size = len(corpus)
    above = (target + 1.0) * float(corpus.sum() + size)
    below = (corpus + 1.0) * float(target.sum() + size)
    return np.floor(1000.0 * np.log(above / below)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean gain of each text's features."""
    schema = f"`{key}` {key_type(docs, key)}, n_words bigint, n_features bigint, weight bigint"
    target, buckets = arrow_schema(schema), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = []
            for value in batch.column(1).to_pylist():
                n, at = feature_buckets(value, buckets)
                found.append((n, len(at), int(gain[at].sum()) // len(at) if n else 0))
            columns = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(target.field(0).type), *[pa.array(c) for c in columns]], schema=target
            )

    return id_and_text(docs, key, text).mapInArrow(run, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by the key: the highest of weight plus noise are a draw without replacement."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


class _Keys:
    """Remaining keys of a partition: scores falling, then keys rising, nulls last."""

    SCHEMA = "part int, side int, n bigint, score bigint, absent int, id bigint"

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Rows (score with the sign changed, whether the key is null, key) in order of rank."""
        parts = []
        for batch in batches:
            parts.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        keys = np.concatenate(parts) if parts else np.empty((0, 3), np.int64)
        return keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]


def _rank_key(score: str, key: str) -> list[Column]:
    return [
        (-F.col(score)).cast("bigint").alias("score"),
        F.col(key).isNull().cast("int").alias("absent"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(0)).cast("bigint").alias("id"),
    ]


def _after(columns: tuple[str, ...], bound: tuple[int, ...], or_equal: bool = False) -> Column:
    """Whether the row's (score, absent, id) comes after the bound."""
    s, a, i = (F.col(c) for c in columns)
    last = i >= bound[2] if or_equal else i > bound[2]
    return (s > bound[0]) | ((s == bound[0]) & ((a > bound[1]) | ((a == bound[1]) & last)))


ORDER = ("score", "absent", "id")


def _medians(keys: DataFrame, pivot: tuple[int, ...] | None) -> list[tuple]:
    """Per partition: size and median key of what lies before (0), at (1) and after (2) the pivot."""
    target = arrow_schema(_Keys.SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = _Keys.read(batches)
        if pivot is None:
            sides = [(0, ordered)]
        else:
            # Numbers of keys before and up to the pivot, by comparing column after column.
            s, a, i = ordered.T
            before = (s < pivot[0]) | ((s == pivot[0]) & ((a < pivot[1]) | ((a == pivot[1]) & (i < pivot[2]))))
            same = (s == pivot[0]) & (a == pivot[1]) & (i == pivot[2])
            low, high = int(before.sum()), int(before.sum() + same.sum())
            sides = [(0, ordered[:low]), (1, ordered[low:high]), (2, ordered[high:])]
        found = [(0, side, len(part), *part[(len(part) - 1) // 2].tolist()) for side, part in sides if len(part)]
        if found:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), target, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return [(r["side"], r["n"], (r["score"], r["absent"], r["id"])) for r in keys.mapInArrow(run, _Keys.SCHEMA).collect()]


def weighted_median(found: list[tuple[int, tuple[int, ...]]]) -> tuple[int, ...]:
    """The first median up to which half of the total weight lies."""
    ordered, half, seen = sorted((key, n) for n, key in found), sum(n for n, _ in found) / 2, 0
    for key, n in ordered:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, wanted: int, few: int = FEW) -> tuple[int, ...]:
    """The key of rank ``wanted`` (from 1) among rows (score, absent, id) in this order.

    The driver sees one median and one size per partition and side; at the end at most ``few`` keys,
    unless one key repeats, which needs no reading.
    """
    low: tuple[int, ...] | None = None
    high: tuple[int, ...] | None = None
    found = [(n, key) for _, n, key in _medians(keys, None)]
    remaining = sum(n for n, _ in found)
    if not 1 <= wanted <= remaining:
        raise ValueError(f"rank {wanted} of {remaining}")
    while remaining > few:
        pivot = weighted_median(found)
        within = keys
        if low is not None:
            within = within.filter(_after(ORDER, low))
        if high is not None:
            within = within.filter(~_after(ORDER, high, or_equal=True))
        sides = _medians(within, pivot)
        sizes = [sum(n for side, n, _ in sides if side == s) for s in range(3)]
        if wanted <= sizes[0]:
            high, kept = pivot, 0
        elif wanted <= sizes[0] + sizes[1]:
            return pivot
        else:
            low, kept, wanted = pivot, 2, wanted - sizes[0] - sizes[1]
        found = [(n, key) for side, n, key in sides if side == kept]
        remaining = sizes[kept]
    rest = keys
    if low is not None:
        rest = rest.filter(_after(ORDER, low))
    if high is not None:
        rest = rest.filter(~_after(ORDER, high, or_equal=True))
    return sorted(tuple(r) for r in rest.collect())[wanted - 1]


def draw_highest(
    scored: DataFrame, eligible: Column, percent: int, key: str = "doc_id", score: str = "score", few: int = FEW
) -> DataFrame:
    """``scored``, which has to be a stored table, with the ``rank`` of the best ``percent`` of its eligible rows.

    Ranks start at 1; ties go to the smaller key; all other rows have a null rank.
    """
    rows = scored.withColumn("_in", F.coalesce(eligible, F.lit(False)))
    keys = rows.filter("_in").select(*_rank_key(score, key))
    wanted = keys.count() * percent // 100
    if not wanted:
        return rows.drop("_in").withColumn("rank", F.lit(None).cast("bigint"))
    last = cutoff(keys, wanted, few)
    names = ("_score", "_absent", "_id")
    placed = rows.withColumns(dict(zip(names, _rank_key(score, key), strict=True)))
    ahead = F.col("_in") & ~_after(names, last)
    winners = running_before(placed.filter(ahead).withColumn("_one", F.lit(1).cast("bigint")), list(names), ["_one"])
    # Only rows equal to the last key can be too many.
    rank = F.when(F.col("before__one") < wanted, F.col("before__one") + 1).cast("bigint")
    others = placed.filter(~ahead).withColumn("rank", F.lit(None).cast("bigint"))
    return winners.withColumn("rank", rank).select(*scored.columns, "rank").unionByName(others.select(*scored.columns, "rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; the drawn ones have a rank."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    weighed = weigh(docs, gain, key, text)
    stored = materialise(weighed.withColumn("score", (F.col("weight") + noise(F.col(key), seed)).cast("bigint")))
    return draw_highest(stored, F.col("n_words") >= least_words, percent, key)
