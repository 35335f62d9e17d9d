import numpy as np
import pytest

from actorlens.llm import line_dedup
from actorlens.llm.cuckoo import CuckooFilter
from actorlens.llm.line_dedup import BLANK, LineIndex
from tests.llm.helpers import documents, empty_documents

A, B, C = "alpha line number one", "beta line number two", "gamma line number three"
TEXTS = [
    f"{A}\n{B}\nshort", f"  {A.upper()}\t\nshort\n{C}", None, "", f"{B}\n{B}\nown words here", f"{C}\r\n{A}", "straßenbahnen\nñañañañaña",
    "STRAßENBAHNEN\nÑAÑAÑAÑAÑA", "\n\n",
]


def expected(texts):
    """Kept texts by brute force."""
    keys = {
        i: [line.encode().strip(BLANK).lower().decode() for line in (t or "").split("\n")] for i, t in texts.items()
    }
    first = {}
    holders = {}
    for i in sorted(keys):
        for k in keys[i]:
            first.setdefault(k, i)
            holders.setdefault(k, set()).add(i)
    lost = lambda i, k: len(k) >= 10 and len(holders[k]) > 1 and first[k] != i
    return {
        i: "\n".join(line for line, k in zip((t or "").split("\n"), keys[i], strict=True) if not lost(i, k))
        for i, t in texts.items()
    }


def kept(index, docs):
    return {r["doc_id"]: r["kept"] for r in index.kept(docs).collect()}


def test_batches_and_deletion_are_exact(spark):
    docs = documents(spark, TEXTS, extra=True)
    all_texts = dict(enumerate(TEXTS))
    index = LineIndex.create(spark)
    index.insert(docs.filter("doc_id % 3 = 1")).insert(docs.filter("doc_id % 3 = 0")).insert(docs.filter("doc_id % 3 = 2"))
    assert kept(index, docs) == expected(all_texts)
    index.delete(docs.filter("doc_id in (0, 6)"))
    left = {i: t for i, t in all_texts.items() if i not in (0, 6)}
    assert kept(index, docs.filter("doc_id not in (0, 6)")) == expected(left)
    # Back again: nothing was lost on the way.
    index.insert(docs.filter("doc_id in (0, 6)"))
    assert kept(index, docs) == expected(all_texts)


def test_shards_grow_with_the_keys_and_versions_become_one(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "VERSIONS", 3)
    texts = [f"{A}\nthe line of number {i}\nshared by several {i % 40}" for i in range(200)]
    docs = documents(spark, texts)
    at_once = LineIndex.create(spark).insert(docs)
    index = LineIndex.create(spark).insert(docs.filter("doc_id = 0"))
    assert index.shards == 1
    index.insert(docs.filter("doc_id > 0"))
    assert index.shards == at_once.shards == 241 // 20 + 1 and index.keys == at_once.keys == 241
    index = LineIndex.create(spark).insert(docs.filter("doc_id = 0"))
    index.insert(docs.filter("doc_id > 0 and doc_id < 150")).insert(docs.filter("doc_id >= 150"))
    assert index.keys == 241 <= 2 * 20 * index.shards
    assert kept(index, docs) == kept(at_once, docs) == expected(dict(enumerate(texts)))
    # Documents go and come back in more batches than versions are kept.
    index.delete(docs.filter("doc_id < 30")).delete(docs.filter("doc_id = 40")).delete(docs.filter("doc_id = 41"))
    gone = [*range(30), 40, 41]
    left = {i: t for i, t in enumerate(texts) if i not in gone}
    assert kept(index, docs.filter(~docs.doc_id.isin(gone))) == expected(left)
    assert index.keys == 241 - 32
    index.insert(docs.filter("doc_id < 30")).insert(docs.filter("doc_id in (40, 41)"))
    assert kept(index, docs) == expected(dict(enumerate(texts))) and index.keys == 241
    assert index._counts().select("v").distinct().count() <= 3


def test_deletion_never_takes_the_print_of_another_key():
    """Small layers with many equal fingerprints: what stays is found, whatever goes."""
    draw = np.random.default_rng(4)
    for _ in range(20):
        keys = draw.integers(0, 1 << 63, 3_000, dtype=np.uint64)
        known = CuckooFilter(capacity=4)
        known._marks = lambda k: ((k >> np.uint64(20)) % np.uint64(5) + np.uint64(1)).astype(np.uint16)
        for part in np.array_split(keys, 9):
            known.insert(part)
        known.delete(keys[:1_000])
        assert known.contains(keys[1_000:]).all()


def test_repeated_rows_and_missing_keys(spark):
    docs = documents(spark, [A, A, B]).union(documents(spark, [A, A, B]))
    nameless = spark.createDataFrame([(None, A, "en", "s", 5)], docs.schema)
    rows = LineIndex.create(spark).insert(docs.union(nameless)).kept(docs.union(nameless)).collect()
    assert sorted((str(r["doc_id"]), r["kept"], r["n_lines"], r["n_dropped"]) for r in rows) == [
        ("0", A, 1, 0), ("0", A, 1, 0), ("1", "", 1, 1), ("1", "", 1, 1), ("2", B, 1, 0), ("2", B, 1, 0), ("None", A, 1, 0),
    ]


def test_empty_table(spark):
    docs = empty_documents(spark)
    index = LineIndex.create(spark).insert(docs).insert(docs).delete(docs)
    assert index.kept(docs, carry=("lang",)).count() == 0


@pytest.mark.parametrize("capacity", [4, 1000])
def test_filter_never_forgets(capacity):
    draw = np.random.default_rng(1)
    keys = draw.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    known = CuckooFilter(capacity=capacity)
    for part in np.array_split(keys[:10_000], 7):
        known.insert(part)
    known = CuckooFilter.from_bytes(known.to_bytes())
    assert known.contains(keys[:10_000]).all()
    assert known.contains(keys[10_000:]).mean() < 0.01
    known.delete(keys[:5_000])
    assert known.contains(keys[5_000:10_000]).all()
    assert known.contains(keys[:5_000]).mean() < 0.01
