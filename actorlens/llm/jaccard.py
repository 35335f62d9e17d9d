"""Exact Jaccard join of word-shingle sets, with links and components.

Filtering. All shingles have one order: those in crowded cells of a table of counts over the whole
corpus come last, others by hash. Any order gives exact results; this one keeps common passages out
of the prefixes. Sets that reach the threshold share a shingle of their prefixes, so an inverted
list per prefix shingle holds every pair. Positions in the prefixes and the sizes bound the overlap;
lists are cut into blocks by size and position, and blocks that cannot hold a pair are never met.

Set relations. Equal sets are one class from the start. Every list has a pivot, the set that looks
most typical, and each set of the list is compared with it. What these answers connect needs no
comparison any more. For any other pair of the list the two overlaps with the pivot bound the
overlap of the pair from both sides: many pairs are decided by that alone. Of the rest those whose
prefixes share too little are out, and only what is left is compared. So a group of thousands of near copies costs about one comparison per copy.

The result is exact up to equal 64-bit hashes of different shingles.

Defined cases: a null or empty text has the empty set, which links with nothing; equal texts are
linked; rows that repeat a document are one; if one key has several texts, links of either count
for the key; rows without a key are left as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema, id_and_text, pieces
from actorlens.llm.components import components
from actorlens.llm.words import mixed, shingles, words
from actorlens.sources.storage import materialise

#: Cells of the table of counts, a fixed size; a larger one tells frequent shingles apart better.
CELLS = 1 << 20
SLABS = 64
#: Sets that one task compares with the same set.
COMPARED = 512
#: Keys that are broadcast at most; more are joined by a shuffle.
FEW_KEYS = 50_000


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = words(batch.column(column))
    for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
        ordered = np.sort(shingles(found.hashes[a:b], width))
        yield ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def _first_pass(docs: DataFrame, width: int) -> DataFrame:
    """(doc, n, hi, lo) of every document, and rows (slab, counts) of each task's table of counts."""
    schema = "doc bigint, n bigint, hi bigint, lo bigint, slab int, counts binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_row = np.zeros(CELLS, np.int64), False
        for batch in pieces(batches):
            sizes, digests = [], []
            for tokens in _sets(batch, 1, width):
                any_row = True
                sizes.append(len(tokens))
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                np.add.at(counts, _cell(tokens), 1)
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 none.cast(pa.int32()), none.cast(pa.binary())],
                schema=target,
            )
        if any_row:
            slabs = counts.reshape(SLABS, -1)
            none = pa.nulls(SLABS).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(range(SLABS), pa.int32()), pa.array([_packed(s) for s in slabs])],
                schema=target,
            )

    return docs.mapInArrow(run, schema)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the smallest whole-number type that holds them, led by its width."""
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        if counts.max(initial=0) <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()
    raise OverflowError("counts pass 64 bits")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _crowding(tables: DataFrame) -> np.ndarray:
    """How crowded each cell is, 0 for the usual; summed slab by slab, the result has a fixed size."""
    schema = "slab int, counts binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = _unpacked(data.as_py())
                sums[slab] = sums[slab] + counts if slab in sums else counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], schema=target
        )

    counts = np.zeros((SLABS, CELLS // SLABS), np.int64)
    for row in tables.select("slab", "counts").repartition("slab").mapInArrow(run, schema).toLocalIterator():
        counts[row["slab"]] = _unpacked(row["counts"])
    flat = counts.ravel()
    usual = flat.mean() + 3 * np.sqrt(flat.mean()) + 4
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(1.0, flat / usual)))).astype(np.uint8)


def _prefixes(docs: DataFrame, width: int, percent: int, crowding: np.ndarray) -> DataFrame:
    """(doc, n, typical, tokens): the prefix of each set in the common order."""
    schema = "doc bigint, n int, typical int, tokens array<bigint>"
    target = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(crowding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = shared.value
        for batch in pieces(batches):
            sizes, typical, found = [], [], []
            for tokens in _sets(batch, 1, width):
                n = len(tokens)
                ranks = crowded[_cell(tokens)]
                length = n - -(-percent * n // 100) + 1 if n else 0
                # Hashes are mixed again, as their leading bits have chosen the cell.
                prefix = tokens[np.lexsort((mixed(tokens), ranks))[:length]]
                sizes.append(n)
                typical.append(int(crowded[_cell(prefix)].sum()) * 1000 // max(1, length))
                found.append(prefix)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(typical, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return docs.mapInArrow(run, schema)


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap of linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (a + b) / (100 + percent))


def _similar(percent: int) -> Column:
    """Whether an overlap makes a link."""
    return F.col("common") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


def overlaps(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, n_a, n_b, common) of distinct pairs of documents.

    The texts of the b's of one a go to that a's text, in groups of about COMPARED.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / COMPARED).cast("int").alias("groups"))
    dealt = pairs.join(groups, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part")
    )
    wanted = materialise(
        dealt.select(F.col("b").alias("doc"), "a", "part", F.lit(1).alias("role")).unionByName(
            dealt.select(F.col("a").alias("doc"), "a", "part", F.lit(0).alias("role")).distinct()
        )
    )
    few = wanted.count() <= FEW_KEYS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc").select("a", "part", "role", "doc", "_text")
    order = ["a", "part", "role", "doc"]
    schema = "a bigint, b bigint, n_a bigint, n_b bigint, common bigint"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in pieces(batches, column=4):
            found = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for (a, part, role, doc), tokens in zip(keys, _sets(batch, 4, width), strict=True):
                if role == 0:
                    at, first = (a, part), tokens
                elif at == (a, part):
                    place = np.minimum(np.searchsorted(first, tokens), max(0, len(first) - 1))
                    common = int(np.count_nonzero(first[place] == tokens)) if len(first) else 0
                    found.append((a, doc, len(first), len(tokens), common))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=target)

    return texts.repartition("a", "part").sortWithinPartitions(*order).mapInArrow(run, schema)


def _promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough for a link.

    Of the set whose prefix ends first in the common order, what the sets share in its prefix lies
    in both prefixes; the rest of it bounds the overlap behind. The larger rest bounds both cases.
    """
    sides = [
        prefixes.select(F.col("doc").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"tokens_{k}"))
        for k in "ab"
    ]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    larger = F.greatest("n_a", "n_b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    behind = F.ceil(F.lit(percent) * larger / 100) - 1
    return both.filter(shared + behind >= _needed(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _candidates(postings: DataFrame) -> DataFrame:
    """(token, doc, n, pos, pivot, n_p) of all lists with two sets or more."""
    # One shuffle serves both: the exchange is the same as long as both read the same columns.
    dealt = postings.repartition("token")
    lists = (
        dealt.groupBy("token")
        .agg(
            F.count("*").alias("_sets"),
            F.max("pos").alias("_furthest"),
            F.max_by(F.struct("doc", "n"), F.struct("typical", -F.col("doc"))).alias("_p"),
        )
        .filter("_sets > 1 and _furthest >= 0")
        .select("token", F.col("_p.doc").alias("pivot"), F.col("_p.n").alias("n_p"))
    )
    return materialise(dealt.join(lists, "token").select("token", "doc", "n", "typical", "pos", "pivot", "n_p"))


def _open_pairs(open_lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure): pairs of unconnected sets that may link; ``sure`` by the pivot's answers alone.

    Rows are met in blocks: the smaller set's block by size is the larger one's or the one below,
    and its position is in the shorter prefix that suffices against larger sets.
    """
    share = percent / 100
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(share) + 1e-9).cast("int")
    suffix = F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent))
    smaller = open_lists.filter(F.col("pos") < F.col("n") - suffix + 1).withColumn("band", band)
    smaller = smaller.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    larger = open_lists.withColumn("band", band)
    x, y = smaller.alias("x"), larger.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    needed = _needed(nx, ny, percent)
    by_place = F.least(nx - F.col("x.pos"), ny - F.col("y.pos")) >= needed
    ox, oy = F.col("x.common"), F.col("y.common")
    most = F.least(ox, oy) + F.least(nx - ox, ny - oy)
    ordered = (nx < ny) | ((nx == ny) & (F.col("x.doc") < F.col("y.doc")))
    may = ordered & (nx * 100 >= ny * percent) & (F.col("x.component") != F.col("y.component")) & by_place
    met = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & may
        & F.coalesce(most >= needed, F.lit(True)),
    )
    sure = F.coalesce(ox + oy - F.col("x.n_p") >= needed, F.lit(False))
    return met.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg(F.max(sure).alias("sure"))


def near_components(
    docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    rows = id_and_text(docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text)), "doc", text)
    first = materialise(_first_pass(rows, width))
    sets = first.filter("slab is null")
    full = sets.filter("n > 0 and doc is not null")
    classes = materialise(full.groupBy("hi", "lo").agg(F.min("doc").alias("class")))
    crowding = _crowding(first.filter("slab is not null"))
    prefixes = _prefixes(rows, width, percent, crowding).filter("n > 0 and doc is not null")
    chosen = materialise(prefixes.join(classes.select(F.col("class").alias("doc")), "doc", "left_semi"))
    postings = chosen.select("doc", "n", "typical", F.posexplode("tokens").alias("pos", "token"))
    candidates = _candidates(postings)

    reach = (F.least("n", "n_p") * 100 >= F.greatest("n", "n_p") * percent) & (F.col("doc") != F.col("pivot"))
    stars = candidates.filter(reach).select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    stars = materialise(_promising(stars, chosen, percent))
    answers = materialise(overlaps(rows, stars, width).distinct())
    links = answers.filter(_similar(percent)).select("a", "b")
    tops = materialise(components(links))

    # Lists whose sets are not all connected yet.
    known = (
        candidates.join(tops.withColumnRenamed("node", "doc"), "doc", "left")
        .withColumn("component", F.coalesce("component", "doc"))
    )
    known = materialise(known)
    mixed_lists = known.groupBy("token").agg(F.min("component").alias("_x"), F.max("component").alias("_y"))
    open_lists = known.join(mixed_lists.filter("_x < _y").select("token"), "token", "left_semi")
    told = answers.select(F.col("a").alias("pivot"), F.col("b").alias("doc"), "common")
    open_lists = open_lists.join(told, ["pivot", "doc"], "left").withColumn(
        "common", F.when(F.col("pivot") == F.col("doc"), F.col("n").cast("bigint")).otherwise(F.col("common"))
    )
    pairs = materialise(_open_pairs(materialise(open_lists), percent))
    # Pairs that are pivot and set have been compared.
    either = answers.select("a", "b").unionByName(answers.select(F.col("b").alias("a"), F.col("a").alias("b")))
    undecided = pairs.filter("not sure").select("a", "b").join(either, ["a", "b"], "left_anti")
    rest = materialise(_promising(undecided, chosen, percent))
    more = pairs.filter("sure").select("a", "b")
    if not rest.isEmpty():
        more = more.unionByName(overlaps(rows, rest, width).filter(_similar(percent)).select("a", "b"))
    more = materialise(more)
    if not more.isEmpty():
        tops = materialise(components(links.unionByName(more)))

    of_class = classes.join(tops.withColumnRenamed("node", "class"), "class", "left").select(
        "hi", "lo", F.coalesce("component", "class").alias("_component")
    )
    return sets.join(of_class, ["hi", "lo"], "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("_component", "doc")).otherwise(F.col("doc")).alias("component_id"),
    )
