import hashlib
import random

from actorlens.llm import fingerprints as fp
from tests.llm.helpers import documents, empty_documents


def test_successors_and_digests(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice("abcde fghij öß漢\n") for _ in range(draw.choice([0, 1, 3, 4, 50, 700]))) for _ in range(150)]
    texts += [None, "", "a", texts[5], "long " * 60_000]
    docs = documents(spark, texts, extra=True)
    rows = {r["doc_id"]: r for r in fp.edited_likeness(docs, ranges=9).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        quarter = len(text) // 4
        new = text[: len(text) - quarter] + following[:quarter]
        marks = [fp.fingerprint(t.encode()) for t in (text, new, following)]
        row = rows[i]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert [row["fingerprint"], row["edited_fingerprint"]] == [m.hex() for m in marks[:2]]
        assert row["near_edited"] == fp.likeness(marks[0], marks[1])
        assert row["near_next"] == fp.likeness(marks[0], marks[2])


def test_counts_do_not_depend_on_parts(monkeypatch):
    data = random.Random(1).randbytes(5_000)
    whole = fp.bucket_counts(data)
    monkeypatch.setattr(fp, "PART", 97)
    assert (fp.bucket_counts(data) == whole).all() and whole.sum() == sum(5_000 - c for _, _, c in fp.TRIPLETS)


def test_likeness_orders_edits():
    draw = random.Random(2)
    words = [("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8)))) for _ in range(4000)]
    text, other = " ".join(words[:600]), " ".join(words[700:1300])
    near = " ".join(words[:550] + words[2000:2050])
    mark = fp.fingerprint(text.encode())
    assert fp.likeness(mark, mark) == 1.0
    assert 1 > fp.likeness(mark, fp.fingerprint(near.encode())) > fp.likeness(mark, fp.fingerprint(other.encode())) >= 0


def test_odd_tables(spark):
    assert fp.edited_likeness(empty_documents(spark)).count() == 0
    one = fp.edited_likeness(documents(spark, ["abcdefgh"])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    docs = documents(spark, ["aaaa", "bbbb"])
    repeated = docs.union(docs).union(spark.createDataFrame([(None, "cccc", "en", "s", 4)], docs.schema))
    rows = sorted((str(r["doc_id"]), r["edited_sha256"][:8]) for r in fp.edited_likeness(repeated).collect())
    expected = [("0", "aaaa"), ("0", "aaab"), ("1", "bbbb"), ("1", "bbbc"), ("None", "ccca")]
    assert rows == sorted((k, hashlib.sha256(t.encode()).hexdigest()[:8]) for k, t in expected)
