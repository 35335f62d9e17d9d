import gzip
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import StructType

from actorlens.sources import rejects, schema_files

SCHEMA = StructType([schema_files.parse_schema_line(x) for x in ("id decimal", "name string", "v double", "n int")])
LINES = [
    "1,a,1.5,7", "2,b", "x,c,1,1", "4,,NA,", "5,e,1e3,2147483648", "6,f,nan,3", "", "8,h,1,2,3", " 9 ,i, 2.5 ,4", "10,j,one,5", "11,k,0x10,6",
]
BAD = {
    2: (None, "2 values instead of 4"), 3: ("id", "no decimal(38,0): x"), 5: ("n", "no int: 2147483648"), 7: (None, "1 values instead of 4"),
    8: (None, "5 values instead of 4"), 10: ("v", "no double: one"), 11: ("v", "no double: 0x10"),
}


def put(folder, name, lines):
    path = os.path.join(folder, name)
    with (gzip.open if name.endswith(".gz") else open)(path, "wt") as out:
        out.write("\n".join(lines) + "\n")
    return path


@pytest.mark.parametrize("name", ["a.csv", "a.csv.gz"])
def test_bad_lines_have_their_place(spark, tmp_path, name):
    checked = rejects.read_checked(spark, put(tmp_path, name, LINES), SCHEMA, "NA")
    found = {r["line"]: (r["column"], r["reason"]) for r in checked.rejects.collect()}
    assert found == BAD
    texts = {r["line"]: r["text"] for r in checked.rejects.collect()}
    assert all(texts[i] == LINES[i - 1] for i in BAD)
    rows = {int(r["id"]): (r["name"], r["v"], r["n"]) for r in checked.rows.collect()}
    assert set(rows) == {1, 4, 6, 9}
    assert rows[1] == ("a", 1.5, 7) and rows[4] == (None, None, None) and rows[9] == ("i", 2.5, 4)


def test_job_fails_after_all_bad_lines_are_kept(spark, tmp_path):
    checked = rejects.read_checked(spark, put(tmp_path, "a.csv", LINES), SCHEMA, "NA")
    with pytest.raises(rejects.RejectedLines, match="line 2 of .*a.csv: 2 values") as failure:
        checked.require()
    assert failure.value.lines == len(BAD) and failure.value.table.count() == len(BAD)
    assert rejects.read_checked(spark, put(tmp_path, "b.csv", LINES[:1]), SCHEMA, "NA").require().count() == 1


def test_lines_are_counted_over_the_blocks_of_a_file(spark, tmp_path):
    """Files that are read in several blocks each, two of them side by side."""
    paths = []
    for name, every in (("one.csv", 700), ("two.csv", 900)):
        lines = [f"{i},name{i},{i}.5,{i}" if i % every else f"{i},bad" for i in range(1, 20_001)]
        paths.append(put(tmp_path, name, lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        checked = rejects.read_checked(spark, paths, SCHEMA)
        found = {(os.path.basename(r["file"]), r["line"]) for r in checked.rejects.collect()}
        blocks = checked.rejects.select("file", "block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {("one.csv", i) for i in range(700, 20_001, 700)} | {("two.csv", i) for i in range(900, 20_001, 900)}
    assert blocks > 10


def test_file_without_lines(spark, tmp_path):
    open(os.path.join(tmp_path, "empty.csv"), "w").close()
    checked = rejects.read_checked(spark, os.path.join(tmp_path, "empty.csv"), SCHEMA)
    assert checked.require().count() == 0


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(PySparkException):
        rejects.read_checked(spark, os.path.join(tmp_path, "none.csv"), SCHEMA)
