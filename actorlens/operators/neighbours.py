"""Exact k nearest neighbours between two tables, by equi-joins only.

Donors are cut into a tree of cells: a cell with more than ``leaf_rows`` donors splits its own
bounding box in slices along every dimension. A query walks down the tree, one join per level,
and keeps the cells whose box comes closer than the distance within which the cells seen so far are
sure to hold k donors. Only the donors of the last few leaves are compared one by one. Boxes hold
the donors' true extremes, so no neighbour can be missed.

A query need not have all coordinates: distances and bounds then run over those it has. Cells that
differ only in a coordinate it lacks are equally near, so in a tree over all dimensions it would have
to keep them all. The donors therefore stand in one tree under several roots, one for each pattern of
coordinates that queries have, with only these coordinates; queries of all patterns walk down
together. Patterns beyond the ``MOST_PATTERNS`` commonest share a root with all dimensions, which serves
any query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actorlens.operators.joins import salted_join
from actorlens.sources.storage import materialise

LEAF_ROWS = 1024
#: Slices of a cell that splits, along each dimension.
SLICES = 4
#: Patterns of coordinates that get a root of their own.
MOST_PATTERNS = 32
#: Queries of a task that walks down the tree, and queries of a leaf that one task compares.
WALKED, COMPARED = 250, 10_000


def _pattern(dims: list[str]) -> Column:
    return F.concat(*[F.when(F.col(d).isNull(), "0").otherwise("1") for d in dims])


def roots(queries: DataFrame, dims: list[str]) -> list[str]:
    """The roots that queries need: a pattern has a 1 for every dimension it covers."""
    counts = queries.groupBy(_pattern(dims).alias("_root")).agg(F.count("*").alias("_n"))
    found = [r["_root"] for r in counts.orderBy(F.desc("_n"), "_root").limit(MOST_PATTERNS + 1).collect()]
    return found if len(found) <= MOST_PATTERNS else sorted({*found[:MOST_PATTERNS], "1" * len(dims)})


def rooted_points(donors: DataFrame, dims: list[str], donor_key: str, k: int, patterns: list[str]) -> DataFrame:
    """The donors under each root (``_root``), with the coordinates it covers.

    Of donors at one and the same point only the k smallest keys can be anyone's neighbours.
    """
    copies = donors.withColumn("_root", F.explode(F.array(*map(F.lit, patterns))))
    covered = {d: F.when(F.substring("_root", i + 1, 1) == "1", F.col(d)) for i, d in enumerate(dims)}
    at_point = W.partitionBy("_root", *dims).orderBy(donor_key)
    return copies.withColumns(covered).withColumn("_nth", F.row_number().over(at_point)).filter(F.col("_nth") <= k).drop("_nth")


def _boxes(donors: DataFrame, dims: list[str], leaf_rows: int) -> DataFrame:
    """Count, extremes and split mark of every cell."""
    extremes = [f"{f}(`{d}`) AS `_{side}_{d}`" for d in dims for side, f in (("lo", "min"), ("hi", "max"))]
    wide = " OR ".join(f"coalesce(`_lo_{d}` < `_hi_{d}`, false)" for d in dims)
    boxes = donors.groupBy("_parent", "_cell").agg(
        F.count("*").alias("_donors"), *[F.expr(e) for e in extremes]
    )
    return boxes.withColumn("_splits", F.expr(f"_donors > {leaf_rows} AND ({wide})"))


def _descend(donors: DataFrame, boxes: DataFrame, dims: list[str]) -> DataFrame:
    """Move the donors of the cells that split into their child cells."""
    split = boxes.filter("_splits").drop("_parent", "_donors", "_splits")
    parts = ", ".join(
        f"string(coalesce(least(int((`{d}` - `_lo_{d}`) / nullif(`_hi_{d}` - `_lo_{d}`, 0) * {SLICES}), {SLICES - 1}), 0))"
        for d in dims
    )
    kept = [f"`{c}`" for c in donors.columns if c not in ("_cell", "_parent")]
    return donors.join(split, "_cell").selectExpr("_cell AS _parent", f"concat(_cell, '/', {parts}) AS _cell", *kept)


def build_tree(
    donors: DataFrame, dims: list[str], leaf_rows: int = LEAF_ROWS
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Boxes per level, and the donors with the level's cell as ``_cell``; a root's name is its first cell's parent."""
    rooted = donors if "_root" in donors.columns else donors.withColumn("_root", F.lit("1" * len(dims)))
    level = materialise(rooted.selectExpr("_root AS _parent", "concat(_root, '/') AS _cell", "*").drop("_root"))
    boxes, members = [], []
    while True:
        box = materialise(_boxes(level, dims, leaf_rows))
        boxes.append(box)
        members.append(level)
        if box.filter("_splits").isEmpty():
            return boxes, members
        level = materialise(_descend(level, box, dims))


def _leaf_donors(boxes: list[DataFrame], members: list[DataFrame]) -> DataFrame:
    """The donors of all leaves with their cell as ``_at``; a cell's name is unique in the tree."""
    leaves = [
        level.join(box.filter("NOT _splits").select("_cell"), "_cell", "left_semi")
        for box, level in zip(boxes, members)
    ]
    return reduce(DataFrame.unionByName, leaves).drop("_parent").withColumnRenamed("_cell", "_at")


def _frontier(queries: DataFrame, boxes: list[DataFrame], dims: list[str], k: int, patterns: list[str]) -> DataFrame:
    """The leaves (``_at``) that may hold a neighbour of each distinct query point (``_q_*``, numbered by ``_query``).

    ``_bound`` is a distance within which there are k donors, null if there are fewer.
    """
    q = [f"_q_{d}" for d in dims]
    root = F.when(_pattern(dims).isin(patterns), _pattern(dims)).otherwise("1" * len(dims))
    points = queries.select(*[F.col(d).alias(f"_q_{d}") for d in dims], root.alias("_at")).distinct()
    points = materialise(points.withColumn("_query", F.monotonically_increasing_id()))
    # Spread by number, as the queries are few bytes and each of them meets many cells. Windows over
    # coordinates would shuffle again, as these are normalised first.
    tasks = points.count() // WALKED + 1
    frontier = points.repartition(tasks, "_query").selectExpr("*", "0L AS _seen", "0D AS _far", "0D AS _near", "double(NULL) AS _bound")
    # A missing coordinate is no distance away from anything.
    outside = [f"coalesce(greatest(`_lo_{d}` - `_q_{d}`, `_q_{d}` - `_hi_{d}`, 0D), 0D)" for d in dims]
    across = [f"coalesce(greatest(`_q_{d}` - `_lo_{d}`, `_hi_{d}` - `_q_{d}`), 0D)" for d in dims]
    near, far = (" + ".join(f"{x} * {x}" for x in side) for side in (outside, across))
    per_query = W.partitionBy("_query")
    nearest_first = per_query.orderBy("_far", "_at").rowsBetween(W.unboundedPreceding, 0)
    for box in boxes:
        children = box.withColumnRenamed("_parent", "_at").drop("_splits")
        met = frontier.join(children, "_at", "left").selectExpr(
            "_query",
            *[f"`{c}`" for c in q],
            "coalesce(_cell, _at) AS _at",
            "coalesce(_donors, _seen) AS _seen",
            f"if(_cell IS NULL, _far, {far}) AS _far",
            f"if(_cell IS NULL, _near, {near}) AS _near",
            "_bound AS _sure",
        )
        # What was sure a level higher still is, and drops cells before the queries' cells are sorted.
        bound = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(per_query)
        frontier = (
            met.filter("_sure IS NULL OR _near <= _sure")
            .withColumn("_held", F.sum("_seen").over(nearest_first))
            .withColumn("_bound", F.least(bound, "_sure"))
            .filter("_bound IS NULL OR _near <= _bound")
            .drop("_held", "_sure")
        )
    return materialise(frontier.select("_query", *q, "_at", "_bound"))


def nearest_in_tree(
    queries: DataFrame, patterns: list[str], boxes: list[DataFrame], members: list[DataFrame], dims: list[str], donor_key: str, k: int = 5
) -> DataFrame:
    """``nearest_neighbours`` among the donors of a tree with these roots."""
    frontier = _frontier(queries, boxes, dims, k, patterns)
    pairs = salted_join(frontier, _leaf_donors(boxes, members), "_at", hot_rows=COMPARED)
    steps = [f"coalesce(`_q_{d}` - `{d}`, 0D)" for d in dims]
    distance = F.expr(" + ".join(f"{x} * {x}" for x in steps))
    nearest = W.partitionBy("_query").orderBy("_distance", donor_key)
    # Rounding is monotone, so a distance is never above that of the far corner of the donor's cell.
    near = pairs.withColumn("_distance", distance).filter("_bound IS NULL OR _distance <= _bound").drop(*dims, "_at", "_bound")
    found = near.withColumn("_nth", F.row_number().over(nearest)).filter(F.col("_nth") <= k).drop("_nth", "_query")
    return found.withColumnsRenamed({f"_q_{d}": d for d in dims})


def nearest_neighbours(
    queries: DataFrame,
    donors: DataFrame,
    dims: list[str],
    donor_key: str,
    k: int = 5,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The k donors nearest to every distinct query point, as (dims, donor columns, ``_distance``).

    Distances are squared Euclidean over those of ``dims`` that the query has; ties go to the smaller
    donor key. Donor columns that share a name with a dimension are dropped.
    """
    patterns = roots(queries, dims)
    tree = build_tree(rooted_points(donors, dims, donor_key, k, patterns), dims, leaf_rows)
    return nearest_in_tree(queries, patterns, *tree, dims, donor_key, k)
