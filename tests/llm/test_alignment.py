import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from actorlens.llm import alignment
from actorlens.llm.queries import QUERIES
from tests.llm.helpers import documents, empty_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """Whole texts through both libraries, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in own]
        self.letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}

    def spelt_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        """(id, start, end) in bytes of both, or nothing."""
        if not text:
            return [], []
        found = []
        for ids, spell in (
            (self.a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(self.letters[c] for c in self.a.id_to_token(i))),
            (self.b.encode(text), self.spelt_b),
        ):
            at, rows, data = 0, [], b""
            for i in ids:
                piece = spell(i)
                rows.append((i, at, at + len(piece)))
                at, data = at + len(piece), data + piece
            if data != (" " + text).encode():
                return [], []
            found.append(rows)
        return found

    def aligned(self, text):
        in_a, in_b = self.tokens(text)
        links, j = [], 0
        for i, start, end in in_a:
            while j and in_b[j][1] > start:
                j -= 1
            while j < len(in_b) and in_b[j][1] < end:
                if in_b[j][2] > start:
                    links.append((i, in_b[j][0]))
                j += 1
            j = max(0, j - 1)
        groups, at = [], 0
        for end in sorted({e for *_, e in in_a} & {e for *_, e in in_b}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if at <= s and e <= end) for side in (in_a, in_b)) if len(in_a) < 300 else (at, end))
            at = end
        return in_a, in_b, groups, links

    def measures(self, texts):
        all_ = [self.aligned(t) for t in texts]
        count = Counter(pair for *_, links in all_ for pair in set(links))
        most = {}
        for (a, _), n in count.items():
            most[a] = max(most.get(a, 0), n)
        rows = []
        for in_a, in_b, groups, links in all_:
            if groups and isinstance(groups[0], tuple):  # of long texts, one pass over the tokens
                i = j = 0
                named = []
                for _, end in groups:
                    part = []
                    for side, k in ((in_a, i), (in_b, j)):
                        ids = []
                        while k < len(side) and side[k][2] <= end:
                            ids.append(str(side[k][0]))
                            k += 1
                        part.append((",".join(ids), k))
                    i, j = part[0][1], part[1][1]
                    named.append(f"{part[0][0]}|{part[1][0]}")
                groups = named
            rows.append((
                len(in_a), len(in_b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            ))
        return rows


@pytest.fixture(scope="module")
def plain():
    return Plain()


ODD = [
    None, "", " ", "  a", "a ", "Hello world", "Hello  world\n\nnext", "▁ piece", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "naïve façade 漢字 🎉🎉 x", "tab\tand\x00nul \x1c\x85   　x y", "it's they'll 123 4567 !? ...", "Hello world", "x" * 3000, "a b " * 2000,
    "﻿bom é ​ z‍w", "word line sep",
]


def test_odd_texts(spark, plain):
    docs = documents(spark, ODD, extra=True).withColumnRenamed("n", "digest")
    docs = docs.union(docs.filter("doc_id = 5"))
    rows = alignment.alignment(docs.repartition(3), A, B).collect()
    texts = [*ODD, ODD[5]]
    expected = plain.measures(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == expected[r["doc_id"]], ODD[r["doc_id"]]
    assert rows[0].__fields__ == ["doc_id", *COLUMNS]


def test_null_keys_and_empty_tables(spark, plain):
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (None, None), (1, "other text")], "doc_id bigint, text string")
    rows = alignment.alignment(docs, A, B).collect()
    expected = plain.measures(["same text", "same text", None, "other text"])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(expected)
    assert alignment.alignment(empty_documents(spark), A, B).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="aehinorst  .1'\n\t Äß漢🎉▁", max_size=120), min_size=1, max_size=4))
def test_stretches_make_whole_texts(texts):
    """The tokens put together from stretches are what both tokenizers make of the whole text."""
    coder, texts = alignment.loaded(A, B), [t for t in texts if t]
    if not texts:
        return
    found = [np.split(ids, until[:-1]) for ids, until in coder.tokens(texts)]
    for i, text in enumerate(texts):
        whole = [coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)]
        spelt = all(b"".join(coder.spelt[s][t] for t in whole[s]) == b" " + text.encode() for s in (0, 1))
        assert [side[i].tolist() for side in found] == (whole if spelt else [[], []])


def test_plain_coder_equals_the_tokenizer():
    """Every word the vocabulary is made of, runs of every ASCII character, and odd mixtures of them."""
    coder, draw = alignment.loaded(A, B), random.Random(4)
    assert coder.plain is not None
    texts = [token.decode("ascii") for token in coder.spelt[0] if token.isascii()]
    texts += [chr(i) * n for i in range(128) for n in (1, 2, 3, 17)]
    texts += ["".join(draw.choices(texts, k=5)) for _ in range(20_000)]
    plain = [e.ids for e in coder.a.encode_batch(texts, add_special_tokens=False)]
    assert [coder.plain.encode_ordinary(t) for t in texts] == plain


def test_memory_is_emptied(monkeypatch):
    coder = alignment.TokenizerPair(A, B)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    for text in ("one two three four five", "six seven eight nine", "one two six", "x" * 500):
        assert [ids.tolist() for ids, _ in coder.tokens([text])] == [coder.a.encode(" " + text).ids, coder.b.encode(text)]
    assert len(coder.number) < 5


def test_hot_texts_and_small_batches(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH", 64)
    monkeypatch.setattr(alignment, "HOT_SHARE", 2)
    texts = ["the hot text"] * 30 + [f"text number {i % 7} of few" for i in range(20)]
    rows = alignment.alignment(documents(spark, texts), A, B).collect()
    expected = plain.measures(texts)
    assert all(tuple(r[c] for c in COLUMNS) == expected[r["doc_id"]] for r in rows) and len(rows) == 50


def test_query(spark, data_dir, plain):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip([r["doc_id"] for r in docs], plain.measures([r["text"] for r in docs]), strict=True))
    rows = QUERIES["op11_tokenizer_alignment"](spark, data_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == expected[r["doc_id"]]
