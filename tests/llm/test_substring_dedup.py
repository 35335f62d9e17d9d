import random

from actorlens.llm import substring_dedup as sd
from tests.llm.helpers import documents, empty_documents


def borders_by_hand(data):
    """The definition, position by position."""
    gear = [int(x) for x in sd._GEAR]
    hashes, h = [], 0
    for byte in data:
        h = (4 * h + gear[byte]) % (1 << 16)
        hashes.append(h * 40503 % (1 << 16))
    cuts = {0, len(data)}
    for i, h in enumerate(hashes):
        before, after = hashes[max(0, i - sd.REACH) : i], hashes[i + 1 : i + 1 + sd.REACH]
        if all(x >= h for x in before) and all(x >= h for x in after):
            at = i + 1
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
            cuts.add(at)
    return sorted(cuts)


def words(draw, n):
    return " ".join("".join(draw.choice("etaoinshrdluäß漢") for _ in range(draw.randint(1, 9))) for _ in range(n))


def test_borders(monkeypatch):
    draw = random.Random(1)
    for text in [words(draw, n) for n in (1, 3, 40, 400)] + ["a" * 3000, "é" * 500, "ab" * 700]:
        data = text.encode()
        assert sd.borders(data) == borders_by_hand(data)
        monkeypatch.setattr(sd, "PART", 101)
        assert sd.borders(data) == borders_by_hand(data)
        monkeypatch.undo()


def by_hand(texts, least=sd.LEAST):
    """(doc, start, stop, first) in code points, with ends compared over the whole texts."""
    cut, first = {}, {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        cuts = borders_by_hand(data) if data else [0]
        cut[i] = (data, list(zip(cuts, cuts[1:], strict=False)))
        for a, b in cut[i][1]:
            first.setdefault(data[a:b], (i, data, a))
    found = []
    for i, (data, parts) in cut.items():
        run, spans = [], []
        for a, b in [*parts, (0, 0)]:
            if b and first[data[a:b]][0] < i:
                run.append((a, b, *first[data[a:b]]))
                continue
            if run:
                start, _, _, theirs, at = run[0]
                while start and at and data[start - 1] == theirs[at - 1]:
                    start, at = start - 1, at - 1
                last, stop, _, theirs, at = run[-1]
                at += stop - last
                while stop < len(data) and at < len(theirs) and data[stop] == theirs[at]:
                    stop, at = stop + 1, at + 1
                while data[start] & 0xC0 == 0x80:
                    start += 1
                while stop < len(data) and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                best = max((y - x, -f) for x, y, f, _, _ in run)
                while spans and start <= spans[-1][1]:
                    x, y, other = spans.pop()
                    start, stop, best = min(start, x), max(stop, y), max(best, other)
                spans.append((start, stop, best))
            run = []
        found += [(i, len(data[:a].decode()), len(data[:b].decode()), -w[1]) for a, b, w in spans if b - a >= least]
    return sorted(found)


def flat(rows):
    return sorted((r["doc_id"], s["start"], s["stop"], s["first_doc_id"]) for r in rows for s in r["repeats"])


def test_planted_passages_are_found_and_clean_texts_stay(spark):
    draw = random.Random(7)
    texts, holders = [], {}
    for p in range(25):
        passage = words(draw, 52)
        for _ in range(2):
            holders.setdefault(p, []).append(len(texts))
            texts.append(f"{words(draw, draw.randint(0, 60))} {passage} {words(draw, draw.randint(0, 60))}")
    clean = len(texts)
    texts += [words(draw, 120) for _ in range(40)]
    texts += [None, "", "short", "short", "x" * 3_000, "x" * 2_000, texts[3], words(draw, 9) + " of" * 60, words(draw, 5) + " of" * 70]
    rows = sd.mark_passages(documents(spark, texts, extra=True)).collect()
    found = flat(rows)
    assert found == by_hand(dict(enumerate(texts)))
    assert (len(texts) - 1) in {d for d, *_ in found}
    assert {(b, a) for a, b in holders.values()} <= {(d, f) for d, _, _, f in found}
    assert not {d for d, *_ in found} & set(range(clean, clean + 40))
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        for s in r["repeats"]:
            assert texts[r["doc_id"]][s["start"] : s["stop"]] == s["passage"]


def test_pieces_of_many_texts_equal_the_definition(spark):
    """Texts put together from few pieces: runs that touch, overlap, and have their first chunks in different texts."""
    draw = random.Random(23)
    stock = [words(draw, draw.randint(1, 30)) for _ in range(30)]
    texts = ["".join(draw.choice(stock)[draw.randint(0, 9) :] for _ in range(draw.randint(0, 12))) for _ in range(120)]
    docs = documents(spark, texts)
    assert flat(sd.mark_passages(docs).collect()) == by_hand(dict(enumerate(texts)))
    assert flat(sd.mark_passages(docs, least=30).collect()) == by_hand(dict(enumerate(texts)), least=30)


def test_recall_at_the_limit():
    """Of passages of just ``LEAST`` bytes over 9 in 10 hold a whole chunk wherever they stand, of those of 120 nearly all."""
    draw = random.Random(5)
    held = {}
    for size in (sd.LEAST, 120):
        hits = 0
        for _ in range(400):
            passage = words(draw, 60).encode().decode("utf-8", "ignore").encode("ascii", "ignore")[:size]
            one, two = (words(draw, 30).encode() + passage + words(draw, 30).encode() for _ in range(2))
            chunks = [{data[a:b] for a, b in zip(sd.borders(data), sd.borders(data)[1:], strict=False)} for data in (one, two)]
            hits += any(c in passage for c in chunks[0] & chunks[1])
        held[size] = hits / 400
    assert held[sd.LEAST] >= 0.9 and held[120] >= 0.99, held


def test_odd_tables(spark):
    assert sd.mark_passages(empty_documents(spark)).count() == 0
    draw = random.Random(3)
    docs = documents(spark, [words(draw, 100)] * 2)
    docs = docs.union(docs).union(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    rows = sorted((str(r["doc_id"]), len(r["repeats"])) for r in sd.mark_passages(docs).collect())
    assert rows == [("0", 0), ("0", 0), ("1", 1), ("1", 1), ("None", 0)]
    # Rows of one key with different texts: each has its own passages.
    other = documents(spark, [words(draw, 100), docs.first()["text"] + " and more"])
    rows = sorted((r["doc_id"], len(r["repeats"])) for r in sd.mark_passages(docs.filter("doc_id = 0").union(other)).collect())
    assert rows == [(0, 0), (0, 0), (0, 0), (1, 1)]


def test_passages_of_short_words_to_their_ends(spark):
    """51 words of 1 to 3 letters, some of them of two bytes, are found whole."""
    draw = random.Random(11)
    short = lambda n: " ".join("".join(draw.choice("abcdefghijklmnoprstuvwß") for _ in range(draw.randint(1, 3))) for _ in range(n))
    texts, planted = [], []
    for _ in range(100):
        passage = short(51)
        for side in "[{":
            planted.append((len(texts), passage))
            texts.append(f"{short(40)} {side}{passage}{side} {short(40)}")
    texts += [None, "", texts[0]]
    rows = {r["doc_id"]: [tuple(s) for s in r["repeats"]] for r in sd.mark_passages(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for doc, passage in planted[1::2]:
        start = texts[doc].index(passage)
        assert rows[doc] == [(start, start + len(passage), doc - 1, passage)]
    assert all(not rows[doc] for doc, _ in planted[::2]) and not rows[200] and not rows[201]
    assert rows[202] == [(0, len(texts[0]), 0, texts[0])]
    assert sd.mark_passages(empty_documents(spark)).count() == 0
