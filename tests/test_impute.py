import math
import random

import pytest

from actorlens.operators import impute, neighbours
from tests.conftest import rows


def brute_neighbours(query, donors, k):
    """Donor keys by (distance, key)."""
    ranked = sorted(donors, key=lambda r: (sum((a - b) * (a - b) for a, b in zip(query, r[1:])), r[0]))
    return sorted(r[0] for r in ranked[:k])


def clouds(rng, n):
    """A dense cluster, a heavy pile of copies, a far cluster and a line."""
    points = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)]
    points += [(1.0, 1.0, 1.0)] * n
    points += [(1000 + rng.gauss(0, 0.01), 1000 + rng.gauss(0, 0.01), -1000.0) for _ in range(n)]
    points += [(float(i), 0.0, 0.0) for i in range(n)]
    return [(f"d{i:05d}", *p) for i, p in enumerate(points)]


@pytest.mark.parametrize("leaf_rows", [4, 32, 100_000])
def test_neighbours_equal_brute_force(spark, leaf_rows):
    rng = random.Random(17)
    donors = clouds(rng, 60)
    queries = [(rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(15)]
    queries += [(1.0, 1.0, 1.0), (500.0, 500.0, -500.0), (1e6, -1e6, 0.0), (30.5, 0.0, 0.0)]
    q = spark.createDataFrame(queries + queries[:3], "x double, y double, z double")
    d = spark.createDataFrame(donors, "key string, x double, y double, z double")
    found = neighbours.nearest_neighbours(q, d, ["x", "y", "z"], "key", 5, leaf_rows)
    result = {}
    for r in found.collect():
        result.setdefault((r["x"], r["y"], r["z"]), []).append(r["key"])
    assert set(result) == set(queries)
    for point, keys in result.items():
        assert sorted(keys) == brute_neighbours(point, donors, 5)


@pytest.mark.parametrize("leaf_rows", [4, 100_000])
def test_queries_with_gaps_share_one_tree(spark, leaf_rows):
    rng = random.Random(18)
    donors = clouds(rng, 60)
    queries = [tuple(None if rng.random() < 0.4 else rng.uniform(-2, 2) for _ in range(3)) for _ in range(40)]
    queries = sorted({q for q in queries if any(v is not None for v in q)}, key=repr)
    q = spark.createDataFrame(queries, "x double, y double, z double")
    d = spark.createDataFrame(donors, "key string, x double, y double, z double")
    result = {}
    for r in neighbours.nearest_neighbours(q, d, ["x", "y", "z"], "key", 5, leaf_rows).collect():
        result.setdefault((r["x"], r["y"], r["z"]), []).append(r["key"])
    assert set(result) == set(queries)
    for point, keys in result.items():
        near = sorted(donors, key=lambda p: (sum((a - v) * (a - v) for a, v in zip(point, p[1:]) if a is not None), p[0]))
        assert sorted(keys) == sorted(r[0] for r in near[:5])


def test_fewer_donors_than_neighbours(spark):
    q = spark.createDataFrame([(0.0,)], "x double")
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "key string, x double")
    found = neighbours.nearest_neighbours(q, d, ["x"], "key", 5)
    assert rows(found, "key") == [("a",), ("b",)]


def test_tree_levels_are_bounded_by_leaf_size(spark):
    rng = random.Random(2)
    donors = spark.createDataFrame(
        [(i, rng.gauss(0, 1) ** 3) for i in range(2_000)], "key bigint, x double"
    )
    boxes, _ = neighbours.build_tree(donors, ["x"], 50)
    leaves = [b.filter("not _splits") for b in boxes]
    assert sum(leaf.agg({"_donors": "sum"}).first()[0] or 0 for leaf in leaves) == 2_000
    assert max(leaf.agg({"_donors": "max"}).first()[0] or 0 for leaf in leaves) <= 50


def knn_by_hand(records, fit, k=5):
    """Scale and fill records of (key, a, b, c) by those of ``fit``."""
    means, sds = [], []
    for j in (1, 2, 3):
        values = [r[j] for r in fit if r[j] is not None]
        mean = sum(values) / len(values)
        means.append(mean)
        sds.append(math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)))

    def scale(r):
        return (r[0], *[None if r[j + 1] is None else round((r[j + 1] - means[j]) / sds[j], 9) for j in range(3)])

    donors = [r for r in map(scale, fit) if None not in r]
    out = {}
    for r in map(scale, records):
        present = [j for j in (1, 2, 3) if r[j] is not None]
        near = sorted(donors, key=lambda x: (sum((r[j] - x[j]) ** 2 for j in present), x[0]))[:k]
        out[r[0]] = tuple(
            round(r[j] if r[j] is not None else sum(x[j] for x in near) / len(near), 6) for j in (1, 2, 3)
        )
    return out


@pytest.mark.parametrize("leaf_rows", [8, 128])
def test_imputer_fits_one_table_and_fills_another(spark, leaf_rows):
    rng = random.Random(23)

    def record(i):
        values = [rng.gauss(5, 2), rng.expovariate(0.1), rng.gauss(0, 1)]
        holes = rng.choice([(), (), (0,), (1, 2), (0, 2)])
        return (f"k{i:04d}", *[None if j in holes else v for j, v in enumerate(values)])

    fit, other = [record(i) for i in range(120)], [record(i) for i in range(1000, 1040)]
    schema = "key string, a double, b double, c double"
    imputer = impute.fit_imputer(spark.createDataFrame(fit, schema), "key", leaf_rows=leaf_rows)
    for table in (fit, other):
        filled = imputer.transform(spark.createDataFrame(table, schema))
        found = {r["key"]: tuple(round(r[c], 6) for c in "abc") for r in filled.collect()}
        expected = knn_by_hand(table, fit)
        assert set(found) == set(expected)
        for key in expected:
            assert found[key] == pytest.approx(expected[key], abs=2e-6)


def test_only_continuous_columns_are_scaled_and_moved_behind(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0, "x"), ("b", 2, 3.0, "y")], "key string, n int, v double, s string"
    )
    out = impute.fit_imputer(df, "key").transform(df)
    assert out.columns == ["key", "n", "s", "v"]
    assert rows(out, "n") == [(1,), (2,)]


def test_constant_column_is_centred_and_empty_row_is_an_error(spark):
    df = spark.createDataFrame([("a", 4.0), ("b", 4.0)], "key string, v double")
    imputer = impute.fit_imputer(df, "key")
    assert rows(imputer.transform(df), "v") == [(0.0,), (0.0,)]
    empty = spark.createDataFrame([("c", None)], "key string, v double")
    with pytest.raises(ValueError):
        imputer.transform(empty)


def test_no_row_is_lost(spark):
    table = spark.createDataFrame(
        [("a", 1.0, 2.0), ("b", 2.0, None), ("c", float("nan"), 5.0), ("d", 4.0, 7.0), ("e", 0.0, 1.0)],
        "key string, x double, y double",
    )
    filled = impute.fit_imputer(table, "key", ["x", "y"], k=2).transform(table)
    assert filled.count() == 5
    assert filled.filter("x IS NULL OR y IS NULL OR isnan(x) OR isnan(y)").isEmpty()


def test_without_complete_rows_filling_is_an_error(spark):
    table = spark.createDataFrame([("a", 1.0, None), ("b", None, 2.0), ("c", 3.0, None)], "key string, x double, y double")
    with pytest.raises(ValueError, match="no complete row"):
        impute.fit_imputer(table, "key", ["x", "y"]).transform(table)
    complete = spark.createDataFrame([("z", 1.0, 2.0)], table.schema)
    assert impute.fit_imputer(table, "key", ["x", "y"]).transform(complete).count() == 1


def test_missing_coordinates_do_not_multiply_the_cells(spark):
    """Queries without y: a tree over x and y would hand them every slice along y."""
    rng = random.Random(5)
    donors = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(3_000)], "key bigint, x double, y double")
    queries = spark.createDataFrame([(rng.random(), None) for _ in range(50)], "x double, y double")
    dims = ["x", "y"]
    patterns = neighbours.roots(queries, dims)
    assert patterns == ["10"]
    boxes, members = neighbours.build_tree(neighbours.rooted_points(donors, dims, "key", 5, patterns), dims, 20)
    frontier = neighbours._frontier(queries, boxes, dims, 5, patterns)
    assert frontier.count() <= 50 * 5
    assert neighbours.nearest_in_tree(queries, patterns, boxes, members, dims, "key", 5).count() == 50 * 5


def test_queries_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WALKED", 10)
    donors = spark.createDataFrame([(i, float(i)) for i in range(200)], "key bigint, x double")
    queries = spark.createDataFrame([(i + 0.25,) for i in range(100)], "x double")
    boxes, _ = neighbours.build_tree(donors, ["x"], 20)
    assert len(neighbours._frontier(queries, boxes, ["x"], 2, ["1"]).inputFiles()) > 5


def test_rarer_patterns_share_the_root_of_all_dimensions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PATTERNS", 1)
    queries = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0)], "x double, y double")
    donors = spark.createDataFrame([(i, float(i), float(9 - i)) for i in range(10)], "key bigint, x double, y double")
    assert neighbours.roots(queries, ["x", "y"]) == ["10", "11"]
    found = neighbours.nearest_neighbours(queries, donors, ["x", "y"], "key", 1, 2)
    assert rows(found, "key") == [(1,), (2,), (6,)]


def test_the_walk_of_a_thousand_points_is_spread(spark):
    points = spark.range(1_000).selectExpr("id AS key", "double(id) AS x", "double(id % 7) AS y")
    dims = ["x", "y"]
    boxes, _ = neighbours.build_tree(neighbours.rooted_points(points, dims, "key", 5, ["11"]), dims, 100)
    assert len(neighbours._frontier(points, boxes, dims, 5, ["11"]).inputFiles()) > 3
