"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text (16 bits, two of them a byte, so 8 bytes back). A chunk
ends where the hash is smallest among the REACH positions on either side: chunks have about twice as
many bytes on average, and an insertion moves no border further than REACH + 8 bytes away. In a text
that repeats one short piece each of its periods is a chunk, so that such stretches match at any
length. A chunk that an earlier document holds, too, is a repeat. Repeats that follow each other are a
run, and runs are anchors: the bytes at their ends are compared with those of the first document, so
that a passage reaches to its true ends, and only then must it have ``least`` bytes. One whole chunk
in the passage is enough.

Digests meet their first document in one aggregation, which combines before its shuffle. The texts
are shuffled once, compressed; each then tells its runs and, once for chunks that follow each other,
the bytes around chunks that it is the first to hold. From there on only ends of runs move. No step
gathers the documents of a digest.

Chunks are told apart by 64 bits of their digest. The chunks at the ends of a run are compared byte
by byte, and a passage ends where they differ; within a run the digest decides.

Defined cases: null and empty texts hold no chunk; the first document is the one with the smallest
key, so rows that repeat a key are one document and no repeats of each other; rows without a key
keep everything; a text shorter than a chunk is one chunk; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema, id_and_text, pieces
from actorlens.sources.storage import materialise

REACH = 12
WINDOW = 8
#: Bytes of a repeated passage.
LEAST = 80
#: Bytes beyond a chunk that its borders can depend on, with room for a character.
MARGIN = REACH + WINDOW + 8
#: Bytes of a text that are looked at together.
PART = 4 << 20

_GEAR = np.random.default_rng(977).integers(0, 1 << 16, 256, dtype=np.uint16)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 8 bytes up to each position, by doubling the bytes covered."""
    h = _GEAR[data]
    for covered in (1, 2, 4):
        doubled = h.copy()
        doubled[covered:] += h[:-covered] << np.uint16(2 * covered)
        h = doubled
    return h * np.uint16(40503)


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row, by their first position."""
    covered, out = 1, h
    while 2 * covered <= width:
        out = np.minimum(out[:-covered], out[covered:])
        covered *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - covered :]) if width > covered else out


def _ends(data: np.ndarray) -> np.ndarray:
    """Positions whose hash is the smallest in reach, before and after; equal ones count alike."""
    edge = np.full(REACH, np.iinfo(np.uint16).max, np.uint16)
    h = _hashes(data)
    lows = _smallest(np.concatenate([edge, h, edge]), REACH)
    return np.flatnonzero((lows[: len(h)] >= h) & (lows[REACH + 1 : REACH + 1 + len(h)] >= h))


def borders(data: bytes) -> list[int]:
    """Starts of the chunks and the end of the text, all at whole characters."""
    whole, found = np.frombuffer(data, np.uint8), [0]
    halo = 2 * REACH + WINDOW
    for start in range(0, len(whole), PART):
        low = max(0, start - halo)
        ends = _ends(whole[low : start + PART + halo]) + low
        found += (ends[(ends >= start) & (ends < start + PART)] + 1).tolist()
    out = []
    for at in found:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        out.append(at)
    return sorted({*out, len(data)})


def chunk_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, doc): the digests of each row's chunks, once per row."""
    schema = "hi bigint, doc bigint"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, counts = [], []
            for value in batch.column(1).to_pylist():
                data = value.encode()
                cuts = borders(data) if data else []
                keys = {xxhash.xxh3_128_digest(data[a:b])[:8] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
                found += keys
                counts.append(len(keys))
            halves = np.frombuffer(b"".join(found), ">i8").astype(np.int64)
            docs_of = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([pa.array(halves), pa.array(docs_of, pa.int64())], schema=target)

    known = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text))
    return id_and_text(known, "doc", text).mapInArrow(run, schema)


def _packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, _key, _packed): the texts compressed before they are shuffled."""
    schema = f"doc bigint, _key {docs.schema[key].dataType.simpleString()}, _packed binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch in pieces(batches):
            packed = [packer.compress(value.encode()) for value in batch.column(1).to_pylist()]
            made = [batch.column(0), batch.column(2), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, target, strict=True)], schema=target)

    known = docs.filter(F.col(key).isNotNull())
    rows = known.select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(key))
    return rows.toDF("doc", "_text", "_key").mapInArrow(run, schema)


def _reaches(cuts: list[int], i: int, size: int) -> tuple[int, int]:
    """From where to where bytes beside chunk ``i`` may agree with another text, if its neighbours are not shared.

    Those are the chunks on either side and as far beyond as a border can depend on: where texts
    agree further, they agree on the border, too, and the next chunk is shared.
    """
    return max(0, cuts[max(0, i - 1)] - MARGIN), min(size, cuts[min(len(cuts) - 1, i + 2)] + MARGIN)


def shared_parts(data: bytes, first_of: dict[int, int], doc: int) -> tuple[list[dict], list[bytes], list[dict]]:
    """What a text shares: its runs of repeated chunks, and the stretches that it is the first to hold.

    A run has the bytes it may reach to (``body``), the code points before them, the end of its first
    chunk and the start of its last one in them. A stretch holds chunks that follow each other, with
    the bytes beside them; each chunk tells its place in it.
    """
    cuts = borders(data) if data else []
    runs, stretches, chunks_of = [], [], []
    left, run, stretch = {h for h, first in first_of.items() if first == doc}, [], []
    counted, chars = 0, 0
    for i, (a, b) in enumerate([*zip(cuts[:-1], cuts[1:], strict=True), (0, 0)]):
        hi = _hi(xxhash.xxh3_128_digest(data[a:b])) if b else 0
        first = first_of.get(hi) if b else None
        if first is not None and first < doc:
            run.append((i, a, b, hi, first))
        elif run:
            (m, _, a_stop, a_hi, _), (n, b_start, _, b_hi, _) = run[0], run[-1]
            low, high = _reaches(cuts, m, len(data))[0], _reaches(cuts, n, len(data))[1]
            while data[low] & 0xC0 == 0x80:
                low += 1
            while high < len(data) and data[high] & 0xC0 == 0x80:
                high += 1
            if low >= counted:
                chars += _characters(data[counted:low])
            else:
                chars -= _characters(data[low:counted])
            counted = low
            size, holder = max((y - x, -f) for _, x, y, _, f in run)
            runs.append({
                "chars": chars, "low": low, "body": data[low:high], "a_stop": a_stop - low, "a_hi": a_hi,
                "b_start": b_start - low, "b_hi": b_hi, "size": size, "first": -holder,
            })
            run = []
        if hi in left and b:
            left.remove(hi)
            stretch.append((i, a, b, hi))
        elif stretch:
            low, high = _reaches(cuts, stretch[0][0], len(data))[0], _reaches(cuts, stretch[-1][0], len(data))[1]
            for j, start, stop, its in stretch:
                at, to = _reaches(cuts, j, len(data))
                chunks_of.append({
                    "hi": its, "stretch": len(stretches), "at": at - low, "start": start - low, "stop": stop - low, "to": to - low,
                })
            stretches.append(data[low:high])
            stretch = []
    return runs, stretches, chunks_of


def _characters(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _hi(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _alike(a: bytes, b: bytes) -> int:
    """Bytes that two strings share at the start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(differ[0]) if len(differ) else n


RUN = "chars:bigint,low:bigint,body:binary,a_stop:bigint,a_hi:bigint,b_start:bigint,b_hi:bigint,size:bigint,first:bigint"
CHUNK = "hi:bigint,stretch:int,at:bigint,start:bigint,stop:bigint,to:bigint"


def _parts(docs: DataFrame, held: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, _key, sig, runs, stretches, chunks): ``shared_parts`` of every row; ``sig`` tells texts of a repeated key apart."""
    schema = (
        f"doc bigint, _key {docs.schema[key].dataType.simpleString()}, sig bigint,"
        f" runs array<struct<{RUN}>>, stretches array<binary>, chunks array<struct<{CHUNK}>>"
    )
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in pieces(batches):
            sigs, found = [], []
            for doc, packed, his, firsts in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                data = opener.decompress(packed) if his else b""
                sigs.append(_hi(xxhash.xxh3_128_digest(data)))
                found.append(shared_parts(data, dict(zip(his, firsts, strict=True)), doc) if his else ([], [], []))
            made = [batch.column(0), batch.column(2), pa.array(sigs, pa.int64())]
            made += [pa.array(c, target.field(3 + i).type) for i, c in enumerate(zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, target, strict=True)], schema=target)

    rows = _packed(docs, key, text).join(held, "doc", "left")
    return rows.select("doc", "_packed", "_key", "_his", "_firsts").mapInArrow(run, schema)


def _agreements(ends: DataFrame, theirs: DataFrame) -> DataFrame:
    """(doc, sig, run, n_before, n_after): bytes that both ends of each run share with the first text, their chunk included."""
    schema = "doc bigint, sig bigint, run int, side int, n bigint"
    target = arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column=4):
            sides, mine, other = (batch.column(i).to_pylist() for i in (3, 4, 5))
            n = [_alike(m, o) if side else _alike(m[::-1], o[::-1]) for side, m, o in zip(sides, mine, other, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], schema=target)

    other = F.when(F.col("side") == 0, F.col("before")).otherwise(F.col("after"))
    both = ends.join(theirs, "hi").select("doc", "sig", "run", "side", "mine", other.alias("other"))
    return both.mapInArrow(compare, schema)


def _merged(runs: list[dict], reach: dict[tuple[int, int], int], least: int) -> list[dict]:
    """The passages of a text from its runs and the bytes that their ends share."""
    out = []
    for no, r in enumerate(runs):
        start, stop = r["a_stop"] - reach.get((no, 0), 0), r["b_start"] + reach.get((no, 1), 0)
        body = r["body"]
        while start < len(body) and body[start] & 0xC0 == 0x80:
            start += 1
        while stop < len(body) and body[stop] & 0xC0 == 0x80:
            stop -= 1
        if start >= stop:
            continue
        chars = r["chars"] + _characters(body[:start])
        new = (r["low"] + start, r["low"] + stop, chars, (r["size"], -r["first"]), body[start:stop])
        while out and new[0] <= out[-1][1]:
            one, other = sorted([out.pop(), new], key=lambda p: p[0])
            joined = one[4] + other[4][max(0, one[1] - other[0]) :]
            new = (one[0], max(one[1], other[1]), one[2], max(one[3], other[3]), joined)
        out.append(new)
    found = []
    for low, high, chars, (_, first), passage in out:
        if high - low >= least:
            value = passage.decode()
            found.append({"start": chars, "stop": chars + len(value), "first_doc_id": -first, "passage": value})
    return found


def mark_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, repeats) of every row: (start, stop, first_doc_id, passage) in code points, to the true ends."""
    keys = chunk_keys(docs, key, text)
    several = keys.groupBy("hi").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    # Stored, so that the join meets a table and can split the rows of a frequent chunk.
    shared = materialise(several.select("hi", "first"))
    held = keys.join(shared, "hi").groupBy("doc").agg(F.collect_set(F.struct("hi", "first")).alias("_held"))
    held = held.select("doc", F.col("_held.hi").alias("_his"), F.col("_held.first").alias("_firsts"))
    parts = materialise(_parts(docs, held, key, text))

    runs = parts.select("doc", "sig", F.posexplode("runs").alias("run", "r"))
    side = lambda n, hi, mine: F.struct(F.lit(n).alias("side"), hi.alias("hi"), mine.alias("mine"))
    body = F.col("r.body")
    sides = F.array(
        side(0, F.col("r.a_hi"), F.substr(body, F.lit(1), F.col("r.a_stop").cast("int"))),
        side(1, F.col("r.b_hi"), F.substr(body, (F.col("r.b_start") + 1).cast("int"))),
    )
    ends = runs.select("doc", "sig", "run", F.explode(sides).alias("e")).select("doc", "sig", "run", "e.*")

    wanted = parts.select(F.explode(F.flatten(F.transform("runs", lambda r: F.array(r["a_hi"], r["b_hi"])))).alias("hi")).distinct()
    places = parts.select("doc", "sig", F.explode("chunks").alias("c")).select("doc", "sig", "c.*").join(wanted, "hi", "left_semi")
    stretches = parts.select("doc", "sig", F.posexplode("stretches").alias("stretch", "bytes"))
    cut = lambda a, b: F.substr("bytes", (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
    around = F.struct(cut("at", "stop").alias("before"), cut("start", "to").alias("after"))
    theirs = places.join(stretches, ["doc", "sig", "stretch"]).groupBy("hi").agg(F.min(around).alias("_a"))
    theirs = materialise(theirs.select("hi", "_a.*"))

    reached = _agreements(ends, theirs).groupBy("doc", "sig").agg(F.collect_set(F.struct("run", "side", "n")).alias("_reach"))
    joined = parts.join(reached, ["doc", "sig"], "left").select("_key", "runs", "_reach")
    schema = (
        f"`{key}` {docs.schema[key].dataType.simpleString()},"
        " repeats array<struct<start:bigint,stop:bigint,first_doc_id:bigint,passage:string>>"
    )
    target = arrow_schema(schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats = []
            for its, reach in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                repeats.append(_merged(its, {(e["run"], e["side"]): e["n"] for e in reach or ()}, least))
            made = [batch.column(0), pa.array(repeats, target.field(1).type)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, target, strict=True)], schema=target)

    nameless = docs.filter(F.col(key).isNull()).select(
        F.col(key), F.array().cast(docs.sparkSession.createDataFrame([], schema).schema["repeats"].dataType).alias("repeats")
    )
    return joined.mapInArrow(finish, schema).unionByName(nameless)
