import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from actorlens.llm import bpe
from actorlens.llm.queries import QUERIES
from tests.llm.helpers import documents, empty_documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aehinorst .1'\nÄß漢🎉", max_size=200))
def test_equals_the_merges(text):
    coder = bpe.loaded(PATH, public_tokenizers.PATTERN)
    ids = coder.encode(text).tolist()
    assert ids == _reference().encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


_CACHE = {}


def _reference():
    if "e" not in _CACHE:
        ranks = bpe.loaded(PATH, public_tokenizers.PATTERN).ranks
        _CACHE["e"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE["e"]


def test_long_matches_take_linear_time(reference):
    coder = bpe.loaded(PATH, public_tokenizers.PATTERN)
    for piece in ("a" * 30_000, "ab" * 20_000, " " * 30_001 + "x", "=" * 40_000, "aehinorst" * 3_000):
        assert coder.encode(piece).tolist() == reference.encode_ordinary(piece)


def test_small_table(spark, reference):
    texts = [None, "", "Hello world", "Hello world", "x" * 5000, " \n\t "]
    docs = documents(spark, texts, extra=True)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in rows} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encode(empty_documents(spark), PATH, public_tokenizers.PATTERN).count() == 0
    at_once = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(at_once.collect()) == sorted(rows)
    assert bpe.round_trip(empty_documents(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, data_dir, reference):
    texts = dict(spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect())
    for row in QUERIES["op3_byte_bpe"](spark, data_dir).collect():
        text = texts[row["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
