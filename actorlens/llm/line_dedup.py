"""Reversible line dedup over an index that grows by batches.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least
``least`` code points that two or more documents hold lose their lines everywhere but in the
document with the smallest key. The index of a corpus is a folder with

* ``refs``: one row per (document, key) and change, +1 or -1: the exact references,
* ``counts``: per key and version the exact number of references and the first and last document;
  the latest version of a key holds,
* ``filters``: per shard of the keys a cuckoo filter of all keys with a reference.

A batch looks its keys up in the filters first. Only keys that may be known are joined with the
exact counts, and only keys that turn out to be new enter the filters. Deleting documents takes
their references back, restores the first document of each key from the references, and removes
keys without a reference from the filters, so that lines come back. After VERSIONS batches the counts
become one table again, and the references too if some were taken back. Then, and when the keys have
outgrown their shards, the filters are made anew from the exact counts, in as many shards as the keys
need; as shards must have doubled for that, a key is moved a bounded number of times.

Keys are told apart by a 128-bit hash. Keys spread over shards by their hash; references of a key
are combined before any shuffle, and no step gathers the documents of a key.

Defined cases: a null or empty text is one empty line; rows that repeat one document are one
document; a row without document key keeps all lines and counts for nothing; extra columns are
carried on request only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema, id_and_text, pieces
from actorlens.llm.cuckoo import CuckooFilter
from actorlens.sources.storage import checkpointed, release, scratch_path

BLANK = b" \t\n\r\x0b\x0c"
#: Keys of a shard when it is made; shards are made anew when they have twice as many on average.
SHARD_KEYS = 65_536
#: Batches whose counts are read together before they become one table again.
VERSIONS = 8
KEY = ["hi", "lo"]


def _digest(line: bytes, least: int) -> bytes | None:
    """Hash of a line's key, none for keys that are too short."""
    line = line.strip(BLANK).lower()
    if len(line) < least or (len(line) < 4 * least and len(line.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(line)


def _longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.array(halves[:, 0]), pa.array(halves[:, 1])


def line_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(hi, lo, doc): the keys of each row's lines, once per row."""
    schema = "hi bigint, lo bigint, doc bigint"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, counts = [], []
            for value in batch.column(1).to_pylist():
                keys = {d for line in value.encode().split(b"\n") if (d := _digest(line, least))}
                found += keys
                counts.append(len(keys))
            docs_of = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*_longs(found), pa.array(docs_of, pa.int64())], schema=target)

    known = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text))
    return id_and_text(known, "doc", text).mapInArrow(run, schema)


class LineIndex:
    """The index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, least: int = 10, shards: int = 0):
        self.spark, self.folder, self.least = spark, folder, least
        self.shards, self.versions, self.filters = shards, 0, None
        self.keys, self.since, self.deleted = 0, 0, False

    @classmethod
    def create(cls, spark: SparkSession, least: int = 10) -> LineIndex:
        """An empty index in the shared scratch folder."""
        return cls(spark, scratch_path(spark, "line-index"), least)

    def _table(self, name: str, version: int | None = None) -> str:
        return f"{self.folder}/{name}" + (f"/v={version}" if version is not None else "")

    def _counts(self) -> DataFrame:
        """All versions of all counts before the current one."""
        schema = "hi bigint, lo bigint, refs bigint, first bigint, last bigint, again boolean, v int"
        return self.spark.read.schema(schema).parquet(self._table("counts"))

    @staticmethod
    def _latest(counts: DataFrame) -> DataFrame:
        latest = F.max_by(F.struct("refs", "first", "last"), "v")
        return counts.groupBy(*KEY).agg(latest.alias("_l")).select(*KEY, "_l.refs", "_l.first", "_l.last")

    def _by_shard(self, keys: DataFrame, with_filters: bool) -> DataFrame:
        """(shard, blob, hi, lo) with the filter of each shard before its keys."""
        shard = F.pmod(F.col("hi"), F.lit(self.shards)).cast("int")
        rows = keys.select(shard.alias("shard"), F.lit(None).cast("binary").alias("blob"), *KEY)
        if with_filters:
            filters = self.spark.read.parquet(self.filters)
            nothing = F.lit(None).cast("bigint")
            rows = rows.unionByName(filters.select("shard", "blob", nothing.alias("hi"), nothing.alias("lo")))
        return rows.repartition("shard").sortWithinPartitions("shard", F.col("blob").isNull())

    def _look_up(self, keys: DataFrame) -> DataFrame:
        """Keys that may have references, by the filters."""
        schema = "hi bigint, lo bigint"
        target = arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, known, hi, lo in _shards(batches):
                if known is not None and len(lo):
                    seen = known.contains(lo.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(hi[seen]), pa.array(lo[seen])], schema=target)

        return self._by_shard(keys, True).mapInArrow(run, schema)

    def _change_filters(self, keys: DataFrame, insert: bool) -> None:
        """Write the filters anew with keys added or removed."""
        schema = "shard int, blob binary"
        target = arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, known, _, lo in _shards(batches):
                known = known or CuckooFilter(capacity=2 * len(lo))
                (known.insert if insert else known.delete)(lo.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([known.to_bytes()], pa.binary())], schema=target
                )

        path = self._table("filters", self.versions)
        self._by_shard(keys, self.filters is not None).mapInArrow(run, schema).write.parquet(path)
        if self.filters:
            release(self.spark, self.filters)
        self.filters = path

    def _write_refs(self, docs: DataFrame, change: int, key: str, text: str) -> DataFrame:
        path = self._table("refs", self.versions)
        line_keys(docs, key, text, self.least).withColumn("change", F.lit(change)).write.parquet(path)
        return self.spark.read.parquet(path)

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """Add documents that the index does not hold."""
        refs = self._write_refs(docs, 1, key, text)
        keys = refs.groupBy(*KEY).agg(
            F.count("*").alias("refs"), F.min("doc").alias("first"), F.max("doc").alias("last")
        )
        if self.versions:
            seen = self._look_up(keys)
            old = self._latest(self._counts().join(seen, KEY, "left_semi"))
            old = old.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in ("refs", "first", "last")])
            both = keys.join(old, KEY, "left")
            had = F.coalesce(F.col("old_refs"), F.lit(0))
            merged = both.select(
                *KEY,
                (F.col("refs") + had).alias("refs"),
                F.when(had > 0, F.least("first", "old_first")).otherwise(F.col("first")).alias("first"),
                F.when(had > 0, F.greatest("last", "old_last")).otherwise(F.col("last")).alias("last"),
                F.col("old_refs").isNotNull().alias("again"),
                (had == 0).alias("new"),
            )
        else:
            merged = keys.withColumns({"again": F.lit(False), "new": F.lit(True)})
        path = self._table("counts", self.versions)
        merged.write.parquet(path)
        stored = self.spark.read.parquet(path)
        self.keys += stored.filter("new").count()
        self.shards = self.shards or self._shards_needed()
        if self._outgrown():
            self._renew()
        else:
            self._change_filters(stored.filter("new").select(*KEY), insert=True)
            self.versions, self.since = self.versions + 1, self.since + 1
        return self

    def _shards_needed(self) -> int:
        return self.keys // SHARD_KEYS + 1

    def _outgrown(self) -> bool:
        return self.keys > 2 * SHARD_KEYS * self.shards or self.since + 1 >= VERSIONS

    def _renew(self) -> None:
        """All counts as one table, filters made anew from it; the current batch is written but not in the filters."""
        old = [self._table("counts", v) for v in range(self.versions - self.since, self.versions + 1)]
        path = self._table("counts", self.versions + 1)
        live = self._latest(self._counts()).filter("refs > 0")
        live.withColumns({"again": F.lit(False), "new": F.lit(True)}).write.parquet(path)
        release(self.spark, *old)
        if self.deleted:
            self._renew_refs()
        filters, self.filters = self.filters, None
        self.versions, self.since, self.shards = self.versions + 1, 0, self._shards_needed()
        self._change_filters(self.spark.read.parquet(path).select(*KEY), insert=True)
        if filters:
            release(self.spark, filters)
        self.versions, self.since = self.versions + 1, 1

    def _renew_refs(self) -> None:
        """The references that are left, without those that were taken back."""
        folder = self.spark.read.parquet(self._table("refs"))
        old = [self._table("refs", v) for (v,) in folder.select("v").distinct().collect()]
        left = folder.groupBy(*KEY, "doc").agg(F.sum("change").cast("int").alias("change")).filter("change > 0")
        left.write.parquet(self._table("refs", self.versions + 1))
        release(self.spark, *old)
        self.deleted = False

    def delete(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """Take documents back that were inserted with the same texts."""
        gone = self._write_refs(docs, -1, key, text)
        touched = gone.select(*KEY).distinct()
        live = (
            self.spark.read.parquet(self._table("refs"))
            .join(touched, KEY, "left_semi")
            .groupBy(*KEY, "doc")
            .agg(F.sum("change").alias("refs"))
            .filter("refs > 0")
            .groupBy(*KEY)
            .agg(F.sum("refs").alias("refs"), F.min("doc").alias("first"), F.max("doc").alias("last"))
        )
        path = self._table("counts", self.versions)
        touched.join(live, KEY, "left").select(
            *KEY, F.coalesce("refs", F.lit(0)).alias("refs"), "first", "last",
            F.lit(True).alias("again"), F.lit(False).alias("new"),
        ).write.parquet(path)
        gone_keys = self.spark.read.parquet(path).filter("refs = 0").select(*KEY)
        self.keys, self.deleted = self.keys - gone_keys.count(), True
        if self._outgrown():
            self._renew()
        else:
            self._change_filters(gone_keys, insert=False)
            self.versions, self.since = self.versions + 1, self.since + 1
        return self

    def shared(self) -> DataFrame:
        """(hi, lo, first): keys that two or more documents hold now, with the first of them."""
        if not self.versions:
            return self.spark.createDataFrame([], "hi bigint, lo bigint, first bigint")
        # A key with one document that never changed needs no look at its other versions: it has none.
        several = self._counts().filter((F.col("first") < F.col("last")) | F.col("again"))
        # Stored, so that a join on it meets a table and can split the rows of a hot key.
        return checkpointed(self._latest(several).filter("first < last").select(*KEY, "first"))

    def kept(self, docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """(key, kept, n_lines, n_dropped, carried columns): the lines of each row that stay.

        ``docs`` are documents of the index. Only (document, key) pairs meet the shared keys; the
        keys a document loses join its text afterwards.
        """
        losing = (
            line_keys(docs, key, text, self.least)
            .join(self.shared(), KEY)
            .filter("doc > first")
            .groupBy(F.col("doc").alias("_doc"))
            .agg(F.collect_set(F.struct(*KEY)).alias("_lost"))
            .select("_doc", F.col("_lost.hi").alias("_hi"), F.col("_lost.lo").alias("_lo"))
        )
        texts = docs.select(
            docs[key].alias("_key"),
            F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"),
            *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)],
        )
        joined = texts.join(losing, F.col("_key").cast("bigint") == F.col("_doc"), "left").select(
            "_key", "_text", "_hi", "_lo", *[f"_c{i}" for i in range(len(carry))]
        )
        kinds = [docs.schema[c].dataType.simpleString() for c in carry]
        schema = ", ".join(
            [f"`{key}` {docs.schema[key].dataType.simpleString()}", "kept string, n_lines bigint, n_dropped bigint"]
            + [f"`{c}` {kind}" for c, kind in zip(carry, kinds, strict=True)]
        )
        target, least = arrow_schema(schema), self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                kept, totals, dropped = [], [], []
                columns = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
                for value, hi, lo in columns:
                    if not hi:
                        kept.append(value)
                        totals.append(value.count("\n") + 1)
                        dropped.append(0)
                        continue
                    lost = {h.to_bytes(8, "big", signed=True) + x.to_bytes(8, "big", signed=True) for h, x in zip(hi, lo, strict=True)}
                    lines = value.encode().split(b"\n")
                    stay = [line for line in lines if _digest(line, least) not in lost]
                    kept.append(b"\n".join(stay).decode())
                    totals.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                made = [batch.column(0), pa.array(kept, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]
                made += [batch.column(i) for i in range(4, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, target, strict=True)], schema=target)

        return joined.mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, CuckooFilter | None, np.ndarray, np.ndarray]]:
    """(shard, filter, hi, lo) of each shard in rows that are sorted by shard, the filter first."""
    shard, known, parts = None, None, []

    def done():
        halves = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in (0, 1)]
        return shard, known, *halves

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if shard is not None and ids[a] != shard:
                yield done()
                known, parts = None, []
            shard = int(ids[a])
            rows = batch.slice(a, b - a)
            if (blob := rows.column(1)[0].as_py()) is not None:
                known, rows = CuckooFilter.from_bytes(blob), rows.slice(1)
            parts.append([rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)])
    if shard is not None:
        yield done()
