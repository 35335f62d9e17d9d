import hashlib
import math
import random
import re
import zlib

import numpy as np

from actorlens.llm import resampling
from tests.llm.helpers import LOWER, UPPER, documents, empty_documents


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def plain_features(text):
    w = plain_words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def by_hand(docs, items, percent=25, least=20):
    """Rows of (doc_id, n_words, n_features, weight, score, rank)."""
    held, wanted = np.zeros(10000), np.zeros(10000)
    for side, texts in ((held, [t for _, t in docs]), (wanted, items)):
        for t in texts:
            for b in plain_features(t):
                side[b] += 1
    gain = [
        math.floor(1000 * math.log((t + 1) * (held.sum() + 10000) / ((s + 1) * (wanted.sum() + 10000))))
        for s, t in zip(held, wanted, strict=True)
    ]
    rows = []
    for i, text in docs:
        features = plain_features(text)
        weight = sum(gain[b] for b in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(plain_words(text)), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = eligible[: len(eligible) * percent // 100]
    ranks = {}
    for place, row in enumerate(drawn, 1):
        ranks.setdefault(row, []).append(place)
    return sorted(((*r, ranks[r].pop() if ranks.get(r) else None) for r in rows), key=repr)


def as_rows(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_equals_plain_python(spark):
    draw = random.Random(3)
    vocabulary = ["alpha", "Beta", "42", "ÄÖ", "naïve", "漢字", "x_y", "gamma.", "DELTA"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 60))) for _ in range(300)] + [None, "", "...", "w " * 20000]
    docs = documents(spark, texts, extra=True).withColumnRenamed("size", "rank")
    items = spark.createDataFrame([(0, "alpha beta 42 naïve"), (1, None), (2, "漢字 delta")], "item_id bigint, text string")
    found = resampling.resample(docs.repartition(7), items)
    assert as_rows(found) == by_hand(list(enumerate(texts)), ["alpha beta 42 naïve", None, "漢字 delta"])


def test_ties_repeats_and_null_keys(spark):
    text = "a b c " * 10
    rows = [(5, text)] * 9 + [(None, text)] * 4 + [(i, text + f"z{i}") for i in range(20, 30)] + [(40, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent in (0, 10, 25, 50, 100):
        found = resampling.resample(docs, docs.limit(0), percent=percent)
        assert as_rows(found) == by_hand(rows, [], percent)


def test_empty_tables(spark):
    empty = empty_documents(spark)
    assert resampling.resample(empty, empty).collect() == []
    found = resampling.resample(documents(spark, ["few words", None]), empty).collect()
    assert [r["rank"] for r in found] == [None, None]


def test_cutoff_without_reading_keys_off(spark):
    """All the way by medians of partitions of very different sizes."""
    draw = random.Random(1)
    rows = [(draw.choice([-3, 0, 4, draw.randint(-50, 50)]), 0, i % 700) for i in range(2000)] + [(0, 1, 0)] * 300
    ordered = sorted(rows)
    keys = spark.createDataFrame(rows[:1500], "score bigint, absent int, id bigint").coalesce(1)
    keys = keys.union(spark.createDataFrame(rows[1500:], keys.schema).repartition(6)).cache()
    for wanted in (1, 2, 575, 1150, 1725, 2299, 2300):
        assert resampling.cutoff(keys, wanted, few=1) == ordered[wanted - 1]


def test_every_round_discards_a_quarter():
    draw = random.Random(2)
    for _ in range(200):
        parts = [sorted(draw.randint(0, 60) for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(1, 9))]
        pivot = resampling.weighted_median([(len(p), (p[(len(p) - 1) // 2],)) for p in parts])[0]
        everything = [x for p in parts for x in p]
        quarter = len(everything) / 4
        assert sum(x <= pivot for x in everything) >= quarter and sum(x >= pivot for x in everything) >= quarter
