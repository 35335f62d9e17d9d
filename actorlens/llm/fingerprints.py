"""Document fingerprints: quartiles of hashed byte-triplet counts.

A window of five bytes slides over the text; six triplets of its bytes are hashed into buckets and
counted. The digest holds two bits per bucket, the quartile its count lies in, and the logarithm of
the length. Two digests are compared by the distances of their quartiles and of their lengths,
which are bounded; 1 means no difference, 0 the largest possible one.

``edited_likeness`` needs each document's successor in the order of the keys. The table is cut into
ranges of keys with one shuffle of the texts; the first document of each range goes to the range
before as well, and the first of all to the last range.

Defined cases: a null or empty text, and one of fewer than three bytes, has all counts 0; equal
texts have equal digests; rows that repeat a key follow each other in the order of their texts;
rows without a key come last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema, key_type, pieces
from actorlens.llm.ranges import ranges_wanted

BUCKETS = 256
#: Places of a triplet in the window; the first byte of the window is in all of them.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Odd multipliers of the three bytes; one set per kind of triplet.
FACTORS = [[40503 + 2 * k, 31153 + 6 * k, 51749 + 10 * k] for k in range(6)]
#: Distance of two quartiles by their difference.
STEPS = np.array([0, 1, 2, 4], np.int64)
LENGTHS = 64
#: Ranges are dealt by hash; several for each partition even out.
RANGES_PER_PARTITION = 4
PART = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts per bucket; long texts are counted part by part."""
    counts = np.zeros(BUCKETS, np.int64)
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, max(0, len(whole) - 2), PART):
        # The window may reach beyond the part.
        values = whole[start : start + PART + 4].astype(np.uint16)
        for (_, b, c), (x, y, z) in zip(TRIPLETS, FACTORS, strict=True):
            n = min(PART, len(values) - c)
            if n <= 0:
                continue
            h = values[:n] * np.uint16(x) + values[b : b + n] * np.uint16(y) + values[c : c + n] * np.uint16(z)
            h ^= h >> np.uint16(7)
            h *= np.uint16(40503)
            counts += np.bincount(h >> np.uint16(8), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> bytes:
    """Length code, then two bits per bucket: 0 below the first quartile up to 3 above the third."""
    counts = bucket_counts(data)
    edges = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > edges).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = codes @ np.array([64, 16, 4, 1], np.uint8)
    length = min(LENGTHS - 1, int(np.floor(np.log(len(data) + 1) * 3)))
    return bytes([length]) + packed.astype(np.uint8).tobytes()


_QUARTILES = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3
_PAIR = STEPS[np.abs(_QUARTILES[:, None, :] - _QUARTILES[None, :, :])].sum(axis=2)


def likeness(a: bytes, b: bytes) -> float:
    """1 minus the bounded difference score of two digests."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    codes = int(_PAIR[x[1:], y[1:]].sum())
    lengths = min(8, abs(int(x[0]) - int(y[0]))) * 8
    return max(0.0, 1 - (codes + lengths) / (BUCKETS * 1.25))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of characters replaced by the first ones of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int = 0) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    count = ranges or RANGES_PER_PARTITION * ranges_wanted(docs)
    rows = docs.select(
        F.col(key).alias("_key"),
        F.col(key).cast("bigint").alias("_at"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    # Any borders are right; they are bounded by the number of ranges, so they travel with the tasks.
    known = rows.select(F.col("_at").cast("double").alias("_d")).filter("_d is not null")
    shares = [i / count for i in range(1, count)]
    cuts = np.unique(np.array(known.approxQuantile("_d", shares, 0.2 / count) if shares else [], float).astype(np.int64))

    @F.pandas_udf("int")
    def range_of_key(at):
        # Rows without a key belong to the last range.
        missing = at.isna()
        places = np.searchsorted(cuts, at.fillna(0).to_numpy(np.int64), "right")
        return at.__class__(np.where(missing, len(cuts), places), dtype="int32")

    mark = F.xxhash64("_text").alias("_mark")
    place = range_of_key("_at").alias("_range")
    order = F.struct(F.col("_at").isNull().alias("missing"), F.col("_at").alias("at"), F.col("_mark").alias("mark"))
    firsts = (
        rows.select("_at", mark).withColumn("_range", place).groupBy("_range").agg(F.min(order).alias("f")).collect()
    )
    firsts = sorted((r["_range"], r["f"]["at"], r["f"]["mark"]) for r in firsts)
    # The first document of a range also ends the range before; the first of all ends the last one.
    ends = [(at, m, firsts[i - 1][0]) for i, (_, at, m) in enumerate(firsts)]
    ends = rows.sparkSession.createDataFrame(ends, "_first_at bigint, _first_mark bigint, _range int")
    heads = (
        rows.select("*", mark)
        .join(F.broadcast(ends), F.col("_at").eqNullSafe(F.col("_first_at")) & (F.col("_mark") == F.col("_first_mark")))
        .select("_key", "_at", "_text", "_range", F.lit(1).alias("_head"))
    )
    both = rows.select("*", place, F.lit(0).alias("_head")).unionByName(heads)
    ordered = both.repartition(ranges_wanted(docs), "_range").sortWithinPartitions(
        "_range", "_head", F.col("_at").isNull(), "_at", F.xxhash64("_text")
    )
    schema = (
        f"`{key}` {key_type(docs, key)}, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for batch in (p for b in batches for p in pieces(iter([b]), column=2)):
            for k, value, number, head in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if last is not None and last[3] == number and not last[4]:
                    out.append(_compared(last, value, mark := fingerprint(value.encode())))
                else:
                    mark = fingerprint(value.encode())
                last = (k, value, mark, number, head)
            yield _batch(out, target)
            out = []

    return ordered.select("_key", "_at", "_text", "_range", "_head").mapInArrow(run, schema)


def _compared(row: tuple, following: str, next_mark: bytes) -> tuple:
    k, value, mark = row[:3]
    new = edited(value, following).encode()
    new_mark = fingerprint(new)
    return (
        k, len(value), hashlib.sha256(new).hexdigest(), mark.hex(), new_mark.hex(),
        likeness(mark, new_mark), likeness(mark, next_mark),
    )


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in target]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
