"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors of length 1 with cosine c are sqrt(2 - 2c) apart. A hash is a random projection, shifted
and cut into steps; several hashes make a bucket, and several tables of buckets make it likely that
near vectors meet at least once. The number of hashes follows from the number of vectors, so that
buckets stay small, and the number of tables from the recall wanted for pairs at the threshold.

Vectors that are equal collapse into one class first. Buckets with two or more classes are cut
into blocks; a task compares two blocks by matrix products in double precision and returns, per
class, the number of links, and links that span what it found connected, never all pairs. A pair
that meets in several tables counts in the first of them only.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts link with
nothing and are components of their own; vectors of different lengths never link; rows that repeat
a key are one vector if they are equal and otherwise count as several under one key; rows
without a key stay alone; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema
from actorlens.llm.components import components
from actorlens.sources.storage import checkpointed, materialise

#: Width of a hash's step, in units of the vectors' length.
STEP = 2.0
RECALL = 0.98
#: Classes of a block.
BLOCK = 512
SEED = 7


def meeting_rate(distance: float, step: float = STEP) -> float:
    """Probability that two points at a distance share one p-stable hash."""
    ratio = step / distance
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def layout(vectors: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Hashes per table and tables for so many vectors.

    Unrelated vectors are about sqrt(2) apart; with log(n) / -log(rate) hashes one of them is
    expected per bucket.
    """
    near, far = meeting_rate(math.sqrt(2 - 2 * threshold)), meeting_rate(math.sqrt(2))
    hashes = max(4, math.ceil(math.log(max(2, vectors)) / -math.log(far)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))
    return hashes, tables


def _hashed(rows: DataFrame, hashes: int, tables: int, step: float) -> DataFrame:
    """(class_id, buckets): one 64-bit bucket per table."""
    schema = "class_id bigint, buckets array<bigint>"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(SEED + 1).integers(1, 1 << 62, hashes, dtype=np.int64) * 2 + 1
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            found: list[list[int]] = []
            for start in range(0, batch.num_rows, 1024):
                group = lists.slice(start, 1024)
                widths = np.diff(group.offsets.to_numpy())
                values, at = group.flatten().to_numpy(), 0
                same = len(set(widths.tolist())) == 1
                parts = [values.reshape(len(widths), -1)] if same else []
                for width in () if same else widths.tolist():
                    parts.append(values[at : at + width].reshape(1, -1))
                    at += width
                for x in parts:
                    width = x.shape[1]
                    if width not in planes:
                        draw = np.random.default_rng([SEED, width])
                        planes[width] = (
                            draw.standard_normal((width, hashes * tables)), draw.uniform(0, step, hashes * tables)
                        )
                    a, b = planes[width]
                    cells = np.floor((x @ a + b) / step).astype(np.int64).reshape(len(x), tables, hashes)
                    with np.errstate(over="ignore"):
                        found += ((cells * mix).sum(axis=2) * 31 + width).tolist()
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, target.field(1).type)], schema=target)

    return rows.select("class_id", "unit").mapInArrow(run, schema)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(key).cast("bigint").alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    largest = F.array_max(F.transform("_v", F.abs))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("_key").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0) & finite & (largest > 0)
    usable = F.coalesce(usable, F.lit(False))
    # Divided by the largest part first: squares neither overflow nor vanish.
    scaled = rows.filter(usable).withColumn("_s", F.transform("_v", lambda x: x / largest))
    norm = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x * x))
    units = scaled.withColumn("unit", F.transform("_s", lambda x: x / norm + 0.0)).withColumn(
        "_mark", F.sha2(F.array_join(F.col("unit").cast("array<string>"), ","), 256)
    )
    members = materialise(units.select("_key", "_mark", "unit"))
    classes = materialise(
        members.groupBy("_mark").agg(F.min("_key").alias("class_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    )
    hashes, tables = layout(classes.count(), threshold, recall)
    hashed = materialise(_hashed(classes, hashes, tables, STEP))
    # Ids of classes are smallest keys; a key with several different vectors has several classes.
    meeting = hashed.select("class_id", F.posexplode("buckets").alias("table", "bucket"))
    sizes = checkpointed(
        meeting.groupBy("table", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
        .select("table", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    placed = meeting.join(sizes, ["table", "bucket"]).withColumn(
        "block", F.pmod(F.xxhash64("class_id", "table"), F.col("blocks")).cast("int")
    )
    # Block i meets block j >= i in task (i, j); a class goes to all tasks of its block.
    block, last = F.col("block"), F.col("blocks") - 1
    pairs = F.concat(
        F.transform(F.sequence(block, last), lambda j: F.struct(block.alias("i"), j.alias("j"))),
        F.when(block > 0, F.transform(F.sequence(F.lit(0), block - 1), lambda i: F.struct(i.alias("i"), block.alias("j"))))
        .otherwise(F.array().cast("array<struct<i:int,j:int>>")),
    )
    dealt = placed.select("class_id", "table", "bucket", "block", F.explode(pairs).alias("p"))
    body = classes.join(hashed, "class_id").select("class_id", "copies", "unit", "buckets")
    work = dealt.join(body, "class_id").select(
        "table", "bucket", "p.i", "p.j", "block", "class_id", "copies", "unit", "buckets"
    )
    order = ["table", "bucket", "i", "j", "block", "class_id"]
    found = materialise(
        work.repartition(*order[:4]).sortWithinPartitions(*order).mapInArrow(_comparer(threshold), "class_id bigint, other bigint, links bigint")
    )
    linked = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    tops = components(found.filter("other is not null").select(F.col("class_id").alias("a"), F.col("other").alias("b")))
    named = (
        classes.select("_mark", "class_id", "copies")
        .join(linked, "class_id", "left")
        .join(tops.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select(
            "_mark",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    alone = rows.filter(~usable).select("_key", F.lit(0).cast("bigint").alias("n_links"), F.col("_key").alias("component_id"))
    result = members.join(named, "_mark").select("_key", "n_links", "component_id").unionByName(alone)
    return result.select(
        F.col("_key").alias(key), "n_links", "component_id", F.coalesce(F.col("_key") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _comparer(threshold: float):
    """Compares the two blocks of each task in rows that are sorted by task and block."""
    target = arrow_schema("class_id bigint, other bigint, links bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (table, _, i, j), rows in _tasks(batches):
            ids, copies, units, buckets, blocks = rows
            left, right = blocks == i, blocks == j
            links, edges = _links(table, ids, copies, units, buckets, left, right, i == j, threshold)
            has = links > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[has], edges[:, 0]])),
                    pa.array([None] * int(has.sum()) + edges[:, 1].tolist(), pa.int64()),
                    pa.array(np.concatenate([links[has], np.zeros(len(edges), np.int64)])),
                ],
                schema=target,
            )

    return run


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if key is not None and key != tuple(keys[a].tolist()):
                yield key, _joined(parts)
                parts = []
            key = tuple(keys[a].tolist())
            parts.append(batch.slice(a, b - a))
    if key is not None:
        yield key, _joined(parts)


def _joined(parts: list[pa.RecordBatch]) -> tuple:
    rows = pa.Table.from_batches(parts).combine_chunks()
    blocks, ids, copies = (rows.column(c).to_numpy() for c in (4, 5, 6))
    units = [np.asarray(x) for x in rows.column(7).to_pylist()]
    buckets = np.array(rows.column(8).to_pylist())
    return ids, copies, units, buckets, blocks


def _links(table, ids, copies, units, buckets, left, right, within, threshold):
    """Links per class, and links that span the connected ones, of the pairs that meet first here."""
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    links, edges = np.zeros(len(ids), np.int64), np.empty((0, 2), np.int64)
    # The width is part of a bucket, so vectors of one bucket are equally long but for hash collisions.
    if len({len(units[x]) for x in (*a, *b)}) != 1:
        widths = np.array([len(u) for u in units])
        pieces = []
        for width in np.unique(widths):
            some, found = _links(table, ids, copies, units, buckets, left & (widths == width), right & (widths == width), within, threshold) if (left & (widths == width)).any() and (right & (widths == width)).any() else (0, edges)
            links, pieces = links + some, [*pieces, found]
        return links, np.concatenate(pieces) if pieces else edges
    x, y = np.array([units[k] for k in a]), np.array([units[k] for k in b])
    near = x @ y.T >= threshold
    if within:
        near &= ~np.eye(len(a), dtype=bool)
    rows, columns = np.nonzero(near)
    first = (buckets[a[rows], :table] != buckets[b[columns], :table]).all(axis=1) if table else np.ones(len(rows), bool)
    rows, columns = rows[first], columns[first]
    np.add.at(links, a[rows], copies[b[columns]])
    if not within:
        np.add.at(links, b[columns], copies[a[rows]])
    return links, _spanning(ids[a[rows]], ids[b[columns]])


def _spanning(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """At most one link per class: each to the smallest class it is connected with."""
    if not len(u):
        return np.empty((0, 2), np.int64)
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.column_stack([nodes[moved], nodes[label[moved]]])
