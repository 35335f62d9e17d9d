import random

import pytest

from actorlens.llm import mixing
from actorlens.llm.queries import QUERIES
from tests.llm.helpers import ascii_words, documents, empty_documents


def targets_by_hand(sizes, share=1.5, weights=(5, 2, 1), most=2):
    """Excess over a cap is given to the other sources round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, result = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            result |= {s: left * weight[s] / total for s in open_}
            break
        result |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return result


def test_targets_are_met(spark):
    draw = random.Random(4)
    sources = [draw.choice(["b", "a", "ü", None, "zz", "c"]) for _ in range(900)]
    texts = ["w " * draw.choice([0, 1, 5, 5, 5, 30, 200]) for _ in sources]
    docs = documents(spark, texts, sources, extra=True)
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    sizes, taken, largest, target = {}, {}, {}, {}
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == len(ascii_words(texts[r["doc_id"]])) and 0 <= r["copies"] <= 2
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        largest[s], target[s] = max(largest.get(s, 0), r["size"]), r["target"]
    assert len(rows) == len(texts)
    for s, wanted in targets_by_hand(sizes).items():
        assert target[s] == pytest.approx(wanted)
        assert abs(taken[s] - wanted) <= largest[s]


def test_odd_tables(spark):
    assert mixing.mix(empty_documents(spark)).count() == 0
    rows = mixing.mix(documents(spark, [None, "", " \t"], ["a", None, "b"])).collect()
    assert [(r["size"], r["target"], r["size"] * r["copies"]) for r in rows] == [(0, 0.0, 0)] * 3
    docs = documents(spark, ["a b c", "d", "e " * 50_000], ["x", "x", "y"])
    assert mixing.mix(docs.union(docs)).count() == 6


def test_query(spark, data_dir):
    rows = QUERIES["op6_source_mixing"](spark, data_dir).toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    sources = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "source").toPandas()
    by_source = rows.merge(sources, on="doc_id").groupby("source").agg({"taken": "sum", "size": "max", "target": "first"})
    assert (abs(by_source["taken"] - by_source["target"]) <= by_source["size"]).all()
