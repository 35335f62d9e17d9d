import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from actorlens.operators import encoding
from tests.conftest import rows

LEVELS = {"color": ["blue", "green", "red"], "shape": ["box", "disc"]}


@pytest.fixture(scope="module")
def words(spark):
    return encoding.from_lists(spark, LEVELS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, "red", 0.5, "box", 7), (2, "pink", 1.5, None, 8), (3, "blue", 0.0, "disc", 9)],
        "id int, color string, size double, shape string, n bigint",
    )


def vectors(encoded):
    out = encoded.select("id", vector_to_array("features").alias("f")).collect()
    return {r["id"]: r["f"] for r in out}


def test_ordinal_gives_unknown_levels_the_next_index(table, words):
    encoded = encoding.encode(table, words, ["id"])
    assert vectors(encoded) == {
        1: [2.0, 0.5, 0.0, 7.0],
        2: [3.0, 1.5, 2.0, 8.0],
        3: [0.0, 0.0, 1.0, 9.0],
    }
    assert encoding.categorical_arity(encoded) == {0: 4, 2: 3}


def test_one_hot_leaves_unknown_blocks_empty(table, words):
    encoded = encoding.encode(table, words, ["id"], one_hot=True)
    assert vectors(encoded) == {
        1: [0.0, 0.0, 1.0, 0.5, 1.0, 0.0, 7.0],
        2: [0.0, 0.0, 0.0, 1.5, 0.0, 0.0, 8.0],
        3: [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 9.0],
    }
    long = encoding.explode_vector(encoded, ["id"], sparse=True)
    assert rows(long.filter("id = 2"), "pos", "value") == [(3, 1.5), (6, 8.0)]


def test_empty_vocabulary_makes_every_level_unknown(spark, table):
    empty = encoding.from_lists(spark, {**LEVELS, "color": []})
    assert vectors(encoding.encode(table, empty, ["id"]))[1] == [0.0, 0.5, 0.0, 7.0]
    assert vectors(encoding.encode(table, empty, ["id"], one_hot=True))[1] == [0.5, 1.0, 0.0, 7.0]


def test_vector_keeps_the_row_it_belongs_to(table, words):
    encoded = encoding.encode(table.repartition(3), words, ["id"])
    assert encoded.columns == [*table.columns, "features"]


def test_columns_without_vocabulary_are_refused(spark, table):
    for levels in ({"color": LEVELS["color"]}, {**LEVELS, "n": ["7"]}):
        with pytest.raises(ValueError):
            encoding.encode(table, encoding.from_lists(spark, levels), ["id"])


def test_vocabulary_has_to_be_contiguous(spark):
    schema = "column string, level string, idx double"
    good = spark.createDataFrame([("c", "b", 1.0), ("c", "a", 0.0), ("x", "a", 7.0)], schema)
    found = encoding.vocabulary(good, ["c", "d"])
    assert found.sizes == {"c": 2, "d": 0}
    assert rows(found.maps) == [("c", "a", 0.0), ("c", "b", 1.0)]
    for wrong in ([("c", "a", 0.0), ("c", "b", 2.0)], [("c", "a", 0.0), ("c", "a", 1.0)], [("c", "a", 1.0)]):
        with pytest.raises(ValueError):
            encoding.vocabulary(spark.createDataFrame(wrong, schema), ["c"])


def test_many_levels_stay_off_the_driver(spark):
    n = 150_000
    ids = spark.range(n).selectExpr("id", "concat('l', id) AS level")
    maps = ids.selectExpr("'level' AS column", "level", "double(id) AS idx")
    words = encoding.vocabulary(maps, ["level"])
    encoded = encoding.encode(ids.unionByName(spark.sql("SELECT -1L AS id, 'none' AS level")), words, ["id"])
    assert encoding.categorical_arity(encoded) == {0: n + 1}
    value = vector_to_array("features")[0]
    wrong = encoded.filter((value != F.col("id")) & ~((F.col("id") == -1) & (value == n)))
    assert encoded.count() == n + 1 and wrong.isEmpty()


def test_labels_from_numbers_and_from_levels(spark, table):
    by_level = encoding.labelled(table, "color", ["red", "pink", "blue"])
    assert rows(by_level, "id", "label") == [(1, 0.0), (2, 1.0), (3, 2.0)]
    assert dict(encoding.labelled(table, "n").dtypes)["label"] == "double"
    with pytest.raises(Exception):
        encoding.labelled(table, "color", ["red"]).collect()


def test_rows_are_encoded_by_the_map_of_their_fold(spark):
    maps = spark.createDataFrame(
        [(0, "c", "a", 0.0), (0, "c", "b", 1.0), (1, "c", "b", 0.0), (1, "d", "a", 0.0)], "fold int, column string, level string, idx double"
    )
    df = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 1, "a"), (4, 1, "b"), (5, 2, "a"), (6, 0, None)], "id int, fold int, c string")
    out = encoding.indexed_by_fold(df, maps, "c")
    assert rows(out, "id", "c_idx") == [(1, 0.0), (2, 1.0), (3, 1.0), (4, 0.0), (5, 0.0), (6, 2.0)]
