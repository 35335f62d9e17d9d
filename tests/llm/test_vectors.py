import numpy as np

from actorlens.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, unit int, class_id int"


def brute_force(table, threshold=0.95):
    ids = sorted(table)
    units = {}
    for i in ids:
        v = table[i]
        if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v, np.float32)):
            x = np.array(v, np.float32).astype(float)
            x = x / np.abs(x).max()
            units[i] = x / np.sqrt((x * x).sum())
    top, links = {i: i for i in ids}, dict.fromkeys(ids, 0)
    linked = [
        (a, b) for a in units for b in units
        if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold
    ]
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    for _ in ids:
        for a, b in linked:
            top[a] = top[b] = min(top[a], top[b])
    return {i: (links[i], top[i], top[i] == i) for i in ids}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    draw = np.random.default_rng(3)
    table = {}
    for group in range(12):
        centre = draw.standard_normal(32)
        for _ in range(int(draw.choice([1, 2, 40]))):
            table[len(table)] = (centre + draw.standard_normal(32) * draw.choice([0, 0.05, 0.2])).tolist()
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None], [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0], [1e-30, 2e-30]]
    for v in odd:
        table[len(table)] = v
    rows = [(i, v, 0, 1, 2) for i, v in table.items()]
    found = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=0.9999).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert got == brute_force(table)


def test_odd_tables(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 0, 0, 0)] * 3 + [(None, [1.0, 0.0], 0, 0, 0)]
    found = sorted((str(r["vec_id"]), r["n_links"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [("1", 2), ("1", 2), ("1", 2), ("None", 0)]


def test_layout_keeps_the_recall():
    for n in (100, 10**6, 10**10):
        hashes, tables = vectors.layout(n, 0.95)
        near = vectors.meeting_rate(np.sqrt(0.1))
        assert 1 - (1 - near**hashes) ** tables >= vectors.RECALL
        assert n * vectors.meeting_rate(np.sqrt(2)) ** hashes <= 1
