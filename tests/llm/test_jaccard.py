import random

import pytest

from actorlens.llm import jaccard
from actorlens.llm.components import components
from tests.llm.helpers import ascii_words, documents, empty_documents


def brute_force(texts, width=4, percent=85):
    sets = {}
    for i, t in texts.items():
        w = ascii_words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def _texts(seed, documents_wanted=160):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    texts = []
    while len(texts) < documents_wanted:
        base = [draw.choice(vocabulary) for _ in range(draw.randint(1, 120))]
        if draw.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        texts.append(base)
        for _ in range(draw.randint(0, 12) if draw.random() < 0.4 else 0):
            copy = list(draw.choice(texts[-5:]))
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(copy)
    order = [" ".join(t) for t in texts]
    draw.shuffle(order)
    return order


def test_against_brute_force(spark):
    texts = [*_texts(1), None, "", " \n\t", "one two", "ONE  two", "one", "Ä b c d", "ä b c d", "x " * 40_000]
    docs = documents(spark, texts, extra=True)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(docs).collect()}
    assert found == brute_force(dict(enumerate(texts)))


def test_two_groups_around_unlike_centres(spark):
    """Many copies of two centres that are near each other but below the threshold."""
    draw = random.Random(5)
    centre = [f"c{i}" for i in range(200)]
    other = centre[:180] + [f"d{i}" for i in range(22)]
    texts = []
    for base in (centre, other):
        for _ in range(40):
            copy = list(base)
            copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(documents(spark, texts)).collect()}
    assert found == brute_force(dict(enumerate(texts)))


def test_empty_table_and_repeated_rows(spark):
    assert jaccard.near_components(empty_documents(spark)).count() == 0
    docs = documents(spark, ["a b c d e", "a b c d e", "z"])
    docs = docs.union(docs).union(spark.createDataFrame([(None, "a b c d e", "en", "s", 9)], docs.schema))
    rows = sorted((str(r["doc_id"]), r["n_shingles"]) for r in jaccard.near_components(docs).collect())
    assert rows == [("0", 2)] * 2 + [("1", 2)] * 2 + [("2", 1)] * 2 + [("None", 2)]


def test_components(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(60, 100)] + [(draw.randrange(50), draw.randrange(50)) for _ in range(30)]
    found = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    top = {i: i for link in links for i in link}
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {i: t for i, t in top.items() if i in linked}


def test_too_few_rounds_fail(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        components(links, rounds=1).collect()
    assert {c for _, c in components(links).collect()} == {0}
