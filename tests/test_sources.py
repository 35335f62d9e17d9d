import gzip
import os

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, StringType

from actorlens.functions import columns
from actorlens.operators.frequency import factor_map, sorted_levels
from actorlens.sources import delimited, factor_maps, schema_files, storage
from tests.conftest import rows

FAILURES = (PySparkException, Py4JError)


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write(text)
    return path


def test_schema_file_types_in_any_case(spark, tmp_path):
    path = put(tmp_path, "a.schema", "x\tDouble\ny  string\nt decimal\nn\tINT\n")
    schema = schema_files.read_schema(spark, path)
    assert [f.name for f in schema] == ["x", "y", "t", "n"]
    assert [f.dataType for f in schema] == [
        DoubleType(), StringType(), DecimalType(38, 0), IntegerType(),
    ]
    assert all(f.nullable for f in schema)


@pytest.mark.parametrize("line", ["x", "x double extra", "", " x double", "x date"])
def test_bad_schema_lines(line):
    with pytest.raises(ValueError):
        schema_files.parse_schema_line(line)


def test_schema_writer_cleans_names_and_round_trips(spark, tmp_path):
    df = spark.createDataFrame([], "`a.b` double, s string, t bigint, n int")
    assert schema_files.schema_lines(df) == ["a_b\tdouble", "s\tstring", "t\tdecimal", "n\tint"]
    path = str(tmp_path / "schema")
    schema_files.write_schema(df, path)
    assert [f.name for f in schema_files.read_schema(spark, path)] == ["a_b", "s", "t", "n"]
    with pytest.raises(ValueError):
        schema_files.schema_lines(spark.createDataFrame([], "d date"))


SCHEMA = "t decimal(38,0), s string, v double"


def test_typed_rows_bind_by_position_without_quotes(spark, tmp_path):
    path = put(tmp_path, "a.csv", '9763200000000000001,a"b,1.5\n2,,-2e3\n')
    df = delimited.read_table(spark, path, columns_schema(SCHEMA))
    assert [(int(r["t"]), r["s"], r["v"]) for r in df.orderBy("t").collect()] == [
        (2, None, -2000.0), (9763200000000000001, 'a"b', 1.5),
    ]
    assert dict(delimited.read_model_table(spark, path, columns_schema(SCHEMA)).dtypes) == {
        "t": "double", "s": "string", "v": "double",
    }


def columns_schema(ddl):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


@pytest.mark.parametrize("text", ["x,a,1.0\n", "1,a\n", "1,a,1.0,9\n", "1,a,one\n"])
def test_malformed_rows_fail_the_job(spark, tmp_path, text):
    path = put(tmp_path, "bad.csv", text)
    with pytest.raises(FAILURES):
        delimited.read_table(spark, path, columns_schema(SCHEMA)).collect()


def test_missing_number_fails_only_where_values_are_required(spark, tmp_path):
    path = put(tmp_path, "gap.csv", "1,a,\n")
    table = delimited.read_table(spark, path, columns_schema(SCHEMA))
    assert table.first()["v"] is None
    with pytest.raises(FAILURES):
        delimited.read_model_table(spark, path, columns_schema(SCHEMA)).collect()


def test_gzip_is_read_by_suffix(spark, tmp_path):
    path = os.path.join(tmp_path, "a.csv.gz")
    with gzip.open(path, "wt") as out:
        out.write("1,a,1.0\n2,b,2.0\n")
    df = delimited.read_table(spark, path, columns_schema(SCHEMA), partitions=4)
    assert df.count() == 2
    assert df.rdd.getNumPartitions() == 4
    assert delimited.read_lines(spark, path).count() == 2


def test_header_and_inference(spark, tmp_path):
    path = put(tmp_path, "h.csv", "id,name,v\n1,a,0.5\n3000000000,b,2\n")
    df = delimited.read_with_header(spark, path)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double")]


def test_sink_has_no_header_and_no_quotes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([('a"b', 1.0, None)], "s string, v double, w double")
    delimited.write_table(df, path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ['a"b,1.0,NA']


def test_scored_and_submission_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "b", 1, 0.0, 0.5)], "bid_id bigint, bidder_id string, outcome int, pred double, prob double"
    )
    delimited.write_scored(df, str(tmp_path / "scored"))
    delimited.write_submission(df, str(tmp_path / "submission"))
    assert spark.read.text(str(tmp_path / "scored")).first()[0] == "1,b,1,0.0"
    assert spark.read.text(str(tmp_path / "submission")).first()[0] == "b,0.5"


def test_factor_map_files(spark, tmp_path):
    levels = sorted_levels(spark.createDataFrame([("in",), ("us",), ("at",)], "c string"), "c")
    path = str(tmp_path / "country.map")
    factor_maps.write_factor_map(factor_map(levels), path)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["at\t0", "in\t1", "us\t2"]
    words = factor_maps.read_vocabulary(spark, {"country": path})
    assert words.sizes == {"country": 3}
    assert rows(words.maps) == [("country", "at", 0.0), ("country", "in", 1.0), ("country", "us", 2.0)]
    long = factor_maps.long_factor_maps(spark, {"country": path, "again": path})
    assert long.count() == 6


def test_last_duplicate_of_a_factor_map_wins(spark, tmp_path):
    path = put(tmp_path, "d.map", "a\t0\nb\t1\na\t2\n")
    assert rows(factor_maps.read_factor_map(spark, path)) == [("a", 2.0), ("b", 1.0)]
    folder = tmp_path / "several"
    folder.mkdir()
    put(folder, "part-0", "x\t0\n")
    put(folder, "part-1", "x\t9\n" + "".join(f"y{i}\t{i}\n" for i in range(50)))
    assert ("x", 9.0) in rows(factor_maps.read_factor_map(spark, str(folder)))
    with pytest.raises(FAILURES):
        factor_maps.read_factor_map(spark, put(tmp_path, "e.map", "a\t0\t9\n")).collect()


def test_storage(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "n")
    kept = storage.materialise(df, str(tmp_path / "t"))
    assert rows(kept) == rows(df)
    assert storage.materialise(df.selectExpr("n", "n % 2 as p"), partition_by=["p"]).count() == 10
    empty = storage.empty_table(spark, df.schema)
    assert empty.schema == df.schema and empty.isEmpty()
    assert storage.scratch_path(spark, "x") != storage.scratch_path(spark, "x")
    assert rows(storage.checkpointed(df)) == rows(df)


def test_scratch_lies_below_the_shared_folder_and_can_be_released(spark):
    path = storage.scratch_path(spark, "gone")
    assert path.startswith(storage.shared_folder(spark))
    storage.materialise(spark.range(3), path)
    storage.release(spark, path)
    with pytest.raises(FAILURES):
        spark.read.parquet(path)


def test_column_helpers(spark):
    df = spark.createDataFrame(
        [("1.5", None, 2), ("2", 3.0, None)], "`a.b` string, v double, n int"
    )
    clean = columns.sanitise_names(df)
    assert clean.columns == ["a_b", "v", "n"]
    assert rows(columns.strict_cast(clean, {"a_b": "double"}), "a_b") == [(1.5,), (2.0,)]
    assert columns.drop_columns(clean, ["v", "absent"]).columns == ["a_b", "n"]
    assert columns.continuous_columns(clean) == ["v"]
    assert columns.drop_null_rows(clean, "v").count() == 1
    assert rows(columns.fill_constant(clean, ["v", "n"], 1), "v", "n") == [(1.0, 2), (3.0, 1)]
    with pytest.raises(FAILURES):
        bad = spark.createDataFrame([("x",)], "a string")
        columns.strict_cast(bad, {"a": "double"}).collect()
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double")
    missing = columns.is_missing("v", nan.schema["v"].dataType)
    assert nan.filter(missing).count() == 2
