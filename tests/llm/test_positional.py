import random

from pyspark.sql import functions as F

from actorlens.llm import positional
from tests.llm.helpers import documents, empty_documents
from tests.llm.test_resampling import plain_words


def by_hand(texts, items, size=10):
    """doc -> (n_words, n_hit, items)."""
    cut = {}
    for item, text in items:
        w = plain_words(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            cut.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    rows = []
    for text in texts:
        w = plain_words(text)
        hit, named = set(), set()
        for n in {len(c) for c in cut}:
            for s in range(len(w) - n + 1):
                if (holders := cut.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    named |= holders
        rows.append((len(w), len(hit), sorted(named)))
    return rows


def found_rows(docs, items, size=10):
    return positional.contamination(docs, items, size).collect()


def test_equals_plain_python(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["Äb", "the", "THE", "漢字"]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 2, 3, 4, 7, 9])))) for i in range(25)]
    items += [(100, items[3][1]), (100, "the w1"), (None, "w2, w3; w4"), (101, None), (102, "never seen"), (103, "THE ÄB äb")]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 80))) for _ in range(120)] + [None, "", "?!", "the " * 30, "w1 w2 " * 4000]
    docs = documents(spark, texts, extra=True).withColumnRenamed("n", "ref").withColumnRenamed("key", "pos")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (4, 2):
        expected = by_hand(texts, items, size)
        rows = found_rows(docs.repartition(5), table, size)
        assert len(rows) == len(texts)
        for r in rows:
            assert (r["n_words"], r["n_hit"], r["items"]) == expected[r["doc_id"]]


def test_without_broadcast(spark):
    """The joins give the same when no side is small enough."""
    texts = ["a b c d e f", "x a b c d", "b c d e", "c c c c"] * 5
    items = spark.createDataFrame([(1, "a b c d e"), (2, "c c")], "item_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = found_rows(documents(spark, texts), items, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = by_hand(texts, [(1, "a b c d e"), (2, "c c")], 3)
    assert all((r["n_words"], r["n_hit"], r["items"]) == expected[r["doc_id"]] for r in rows) and len(rows) == 20


def test_repeated_rows_null_keys_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "x"), (None, "b c d"), (None, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "b c"), (7, "b c")], "item_id bigint, text string")
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found_rows(docs, items)), key=repr)
    assert rows == sorted([(1, 3, 2, ["7"]), (1, 3, 2, ["7"]), (1, 1, 0, []), (None, 3, 2, ["7"]), (None, 0, 0, [])], key=repr)
    assert found_rows(empty_documents(spark), items) == []
    assert [r["n_hit"] for r in found_rows(docs, items.limit(0))] == [0] * 5


def test_near(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choices("abcdefgh", k=draw.randint(0, 60))) for _ in range(40)] + ["a " * 50 + "b"]
    queries = {0: ["a", "b"], 1: ["c", "a", "c", "d"], 2: ["h"], 3: ["a", "never"], 4: list("abcde")}
    docs = documents(spark, texts).repartition(3)
    table = spark.createDataFrame(list(queries.items()), "query bigint, terms array<string>")
    index = positional.PositionalIndex.build(docs, table.select(F.explode("terms").alias("term")))
    for span in (1, 3, 6):
        found = index.near(table, span).join(index.texts(), "ref").select("query", "key", "start").collect()
        expected = set()
        for query, terms in queries.items():
            for i, text in enumerate(texts):
                w = plain_words(text)
                expected |= {(query, i, s) for s in range(len(w)) if w[s] in terms and set(terms) <= set(w[s : s + span])}
        assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_no_python_in_the_plan(spark, data_dir):
    from actorlens.llm.queries import QUERIES

    plan = QUERIES["op13_benchmark_decontamination"](spark, data_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
