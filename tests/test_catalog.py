"""Every query with SQL against DuckDB on the generated tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


def normal(value):
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


def table(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for name in os.listdir(data_dir):
        if name.endswith(".parquet"):
            view = name.removesuffix(".parquet")
            connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{data_dir}/{name}'")
    return connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data_dir, duck, name):
    ours = QUERIES[name](spark, data_dir)
    theirs = duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    expected = table(theirs.columns, theirs.fetchall())
    assert table(ours.columns, [tuple(r) for r in ours.collect()]) == expected
    assert expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_imports_without_the_optional_folders(tmp_path):
    """A copy without the subpackage, and one without the pipeline, still import and register the rest."""
    root = os.path.dirname(contract.__file__)
    whole = os.path.isdir(os.path.join(root, "actorlens", "llm")) and os.path.exists(os.path.join(root, "corpus_pipeline.py"))
    for gone in (set(), {"llm"}, {"llm", "corpus_pipeline.py"}, {"corpus_pipeline.py"}):
        copy = tmp_path / "-".join(["without", *sorted(gone)])
        copy.mkdir()
        for name in ("actorlens", "__spark_entry__.py", "corpus_pipeline.py"):
            source = os.path.join(root, name)
            if name in gone or not os.path.exists(source):
                continue
            if os.path.isdir(source):
                shutil.copytree(source, copy / name, ignore=lambda _, names: {n for n in names if n in gone or n == "__pycache__"})
            else:
                shutil.copy(source, copy / name)
        code = "import __spark_entry__ as c; print(*sorted(c.queries()))"
        found = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
        names = set(found.stdout.split())
        optional = {n for n in names if n == "pipeline" or n.startswith("op")}
        assert "per_bidder_features" in names
        assert ("pipeline" in optional) == (whole and not gone)
        assert bool(optional - {"pipeline"}) == ("llm" not in gone and os.path.isdir(os.path.join(root, "actorlens", "llm")))
