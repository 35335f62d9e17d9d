"""Alignment of two tokenizers over a corpus: a byte-level BPE (A) and a piece model with byte fallback (B).

Texts that are equal are shuffled together by their full text, and each distinct one is tokenised
and aligned once. What it links counts as often as it has copies, and measures go back to all rows
that hold the text. Both tokenizers see a space and the text. Byte offsets where a token of A and one
of B both end cut the tokens into groups; an A and a B token are linked where their bytes overlap.

Inside a text neither tokenizer joins anything across a space between two visible characters: A's
splitting pattern starts anew there, and B has no piece with a space behind another character. So the
stretch from one such space to the next is tokenised once and remembered by the worker. Of a text in
which the tokens of some stretch do not spell its bytes, both tokenizers see the whole. Texts are
then aligned by array operations on the bytes of a whole batch.

A pair's count needs all documents, the sum over a document's links needs the counts of all its pairs.
Rows of (document, pair) would be many times the texts, so texts are handled in batches of bounded
size: a batch tells its distinct pairs once, and gets their counts back next to its texts, whose links
are numbers into the batch's pairs.

Defined cases: a null or empty text, or one whose tokens of A or B do not spell it, has no tokens, and
counts for no pair; rows that repeat, with or without a key, are documents each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema, key_type, pieces
from actorlens.sources.storage import materialise

#: Bytes of text aligned together; a longer text is a batch of its own.
BATCH = 4 << 20
#: Stretches a worker remembers; a full memory is emptied.
REMEMBERED = 400_000
LONGEST = 64
#: A space between two characters that surely are neither white space nor empty.
BORDER = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
#: Rows above rows / HOT_SHARE make a text hot; there are at most HOT_SHARE such texts.
HOT_SHARE = 256


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, all others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: Fixed value: how byte-level tokenizers split a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _plain_coder(described: dict, bytes_a: dict[int, bytes]) -> object | None:
    """A faster coder for ASCII, where A is plain byte-level BPE whose ids are in the order of its merges; else None.

    Beyond ASCII libraries may disagree on what a letter is.
    """
    model, before = described["model"], described.get("pre_tokenizer") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if model.get("type") != "BPE" or not level or described.get("normalizer") or model.get("dropout"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m)) for m in merges]
    if None in made or any(x >= y for x, y in zip(made, made[1:], strict=False)):
        return None
    import tiktoken

    special = {t["id"] for t in described.get("added_tokens", ())}
    ranks = {token: i for i, token in bytes_a.items() if i not in special}
    return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Strings:
    """Byte strings by number, joined by array operations."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray, most: int = 1 << 19) -> bytes:
        """The strings of the numbers, one after the other; ``most`` at a time."""
        parts = []
        for at in range(0, len(numbers), most):
            some = numbers[at : at + most]
            lengths = self.lengths[some]
            total = np.cumsum(lengths)
            places = np.repeat(self.starts[some] - total + lengths, lengths) + np.arange(int(total[-1]))
            parts.append(self.data[places].tobytes())
        return b"".join(parts)


class TokenizerPair:
    """Both tokenizers, and the tokens they make of stretches of text. Side 0 is A, side 1 is B."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        with open(path_a, encoding="utf-8") as file:
            described = json.load(file)
        bytes_a = {i: bytes(letters[c] for c in token) for token, i in described["model"]["vocab"].items()}
        bytes_a |= {t["id"]: t["content"].encode() for t in described.get("added_tokens", ()) if t["id"] not in bytes_a}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelt = (
            [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)],
            [
                bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()
                for i, name in enumerate(names)
            ],
        )
        self.size_b = len(names)
        self.bytes_of = tuple(Strings(side) for side in self.spelt)
        # Ids in decimal with what follows them: a comma, or what ends their side of a group.
        self.written = Strings(
            [f"{i}{end}".encode() for side, ends in zip(self.spelt, (",|", ",;"), strict=True) for i in range(len(side)) for end in ends]
        )
        self.plain = _plain_coder(described, bytes_a)
        # Otherwise B could join across a border, and every text has to be seen whole.
        self.cuts = not any("▁" in name.lstrip("▁") for name in names)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # stretch -> its place
        self.ids = (array("i"), array("i"))  # tokens of all stretches
        self.ends = (array("q", [0]), array("q", [0]))  # where the tokens of each place end

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of a space and each part; B puts the space there itself."""
        in_a: list = [None] * len(parts)
        rest = range(len(parts))
        if self.plain is not None:
            code, rest = self.plain.encode_ordinary, [i for i, part in enumerate(parts) if not part.isascii()]
            in_a = [code(" " + part) if part.isascii() else None for part in parts]
        others = self.a.encode_batch([" " + parts[i] for i in rest], add_special_tokens=False)
        for i, encoding in zip(rest, others, strict=True):
            in_a[i] = encoding.ids
        return in_a, self.b.encode(parts, num_threads=1)

    def learn(self, parts: list[str]) -> range:
        """Tokenise stretches and keep them; returns their places."""
        first = len(self.ends[0]) - 1
        for side, found in enumerate(self.encode(parts)):
            ids, ends, end = self.ids[side], self.ends[side], self.ends[side][-1]
            ids.extend(chain.from_iterable(found))
            ends.extend(end + count for count in accumulate(map(len, found)))
        return range(first, first + len(parts))

    def places(self, texts: list[str]) -> list[list[int]]:
        """For every text the places of its stretches."""
        if len(self.number) >= REMEMBERED:
            self.forget()
        cut = [BORDER.split(text) if self.cuts else [text] for text in texts]
        number, found = self.number, []
        new = [p for p in set(chain.from_iterable(cut)).difference(number) if len(p) <= LONGEST]
        number.update(zip(new, self.learn(new), strict=True))
        for parts in cut:
            at = list(map(number.get, parts))
            if None in at:
                long = [i for i, place in enumerate(at) if place is None]
                for i, place in zip(long, self.learn([parts[i] for i in long]), strict=True):
                    at[i] = place
            found.append(at)
        return found

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both sides the tokens of all texts, and where each text's end; none of a text they do not spell."""
        places = self.places(texts)
        flat = np.fromiter(chain.from_iterable(places), np.int64)
        until = np.cumsum([len(at) for at in places])
        sides = []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            ends = np.frombuffer(ends, np.int64)
            begin, count = ends[flat], ends[flat + 1] - ends[flat]
            total = np.cumsum(count)
            chosen = np.repeat(begin - total + count, count) + np.arange(int(total[-1]))
            sides.append((np.frombuffer(ids, np.int32)[chosen].astype(np.int64), total[until - 1]))
        data = [b" " + text.encode() for text in texts]
        if all(self._spell(side, *sides[side], data) for side in (0, 1)):
            return sides
        return self._only_spelt(sides, texts, data)

    def _spell(self, side: int, ids: np.ndarray, until: np.ndarray, data: list[bytes]) -> bool:
        """Whether the tokens of all texts spell them."""
        sizes = np.concatenate([[0], np.cumsum(self.bytes_of[side].lengths[ids])])
        if not np.array_equal(sizes[until], np.cumsum([len(d) for d in data])):
            return False
        return self.bytes_of[side].join(ids) == b"".join(data)

    def _only_spelt(self, sides: list[tuple[np.ndarray, np.ndarray]], texts: list[str], data: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Where stretches do not spell a text, both tokenizers see the whole; if that does not either, it has no tokens."""
        kept: tuple[list, list] = ([], [])
        start = [0, 0]
        for i, (text, spelling) in enumerate(zip(texts, data, strict=True)):
            found = [ids[start[side] : until[i]].tolist() for side, (ids, until) in enumerate(sides)]
            start = [int(until[i]) for _, until in sides]
            for again in (False, True):
                if again:
                    found = [side[0] for side in self.encode([text])]
                if all(b"".join(map(self.spelt[side].__getitem__, found[side])) == spelling for side in (0, 1)):
                    break
            else:
                found = [[], []]
            for side in (0, 1):
                kept[side].append(found[side])
        return [
            (np.fromiter(chain.from_iterable(lists), np.int64), np.cumsum([len(ids) for ids in lists])) for lists in kept
        ]


@lru_cache(maxsize=1)
def loaded(path_a: str, path_b: str) -> TokenizerPair:
    """One pair per worker process."""
    return TokenizerPair(path_a, path_b)


#: One row per distinct text. ``pair_at`` and ``times`` are its links, as places in the pairs of its
#: batch and how often each occurs; the first row of a batch has the pairs and in how many documents they are.
ALIGNED = (
    "batch bigint, digest string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pair_at array<int>, times array<int>, pairs array<bigint>, documents array<bigint>"
)


def _slices(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype())))


@dataclass
class Alignment:
    """Of all texts of a batch: the linked pairs in order, the written groups, and per text where they end."""

    pairs: np.ndarray
    pairs_until: np.ndarray
    written: np.ndarray
    written_until: np.ndarray
    groups: np.ndarray


def align(coder: TokenizerPair, sides: list[tuple[np.ndarray, np.ndarray]]) -> Alignment:
    """Both sides run over the same bytes, so a byte tells by marks and running counts which tokens it is in."""
    ends = [np.cumsum(spelt.lengths[ids]) for spelt, (ids, _) in zip(coder.bytes_of, sides, strict=True)]
    (ids_a, until_a), (ids_b, until_b) = sides
    size = int(ends[0][-1]) if len(ids_a) else 0
    marks = [np.zeros(size + 1, bool) for _ in ends]
    for mark, at in zip(marks, ends, strict=True):
        mark[at] = True
    # Tokens that end before a byte, which is the number of the token that holds it.
    counts = [np.cumsum(mark, dtype=np.int32) for mark in marks]
    some, both = np.flatnonzero(marks[0] | marks[1]), marks[0] & marks[1]
    pairs = ids_a[counts[0][some - 1]] * coder.size_b + ids_b[counts[1][some - 1]]
    groups_before = np.cumsum(both, dtype=np.int32)
    text_ends = np.concatenate([[0], ends[0]])[until_a]
    pairs_until = np.searchsorted(some, text_ends, "right")
    groups = np.diff(groups_before[text_ends], prepend=0) if len(text_ends) else np.empty(0, np.int64)
    # A group's tokens of A are written before its tokens of B.
    in_group = [groups_before[at - 1] for at in ends]
    number = int(groups_before[-1])
    held_a, held_b = (np.bincount(g, minlength=number) for g in in_group)
    written = np.empty(len(ids_a) + len(ids_b), np.int64)
    written[np.arange(len(ids_a)) + (np.cumsum(held_b) - held_b)[in_group[0]]] = 2 * ids_a + both[ends[0]]
    written[np.arange(len(ids_b)) + np.cumsum(held_a)[in_group[1]]] = 2 * (len(coder.spelt[0]) + ids_b) + both[ends[1]]
    return Alignment(pairs, pairs_until, written, until_a + until_b, groups)


def _align_batch(coder: TokenizerPair, number: int, batch: pa.RecordBatch, target: pa.Schema) -> pa.RecordBatch:
    digests, texts, copies = (batch.column(i) for i in range(3))
    sides = coder.tokens(texts.to_pylist())
    found, rows = align(coder, sides), batch.num_rows
    shas, start = [], 0
    for stop in found.written_until.tolist():
        line = coder.written.join(found.written[start:stop])
        shas.append(hashlib.sha256(line[:-1]).hexdigest() if line else "")
        start = stop
    n_links = np.diff(found.pairs_until, prepend=0)
    # Numbers of pairs within the batch, then distinct (text, pair) with their occurrences.
    at, pairs = pd.factorize(found.pairs)
    held, times = np.unique(np.repeat(np.arange(rows), n_links) * max(len(pairs), 1) + at, return_counts=True)
    held_text, held_at = np.divmod(held, max(len(pairs), 1))
    weight = copies.to_numpy(zero_copy_only=False)
    documents = np.bincount(held_at, weight[held_text], len(pairs))
    bounds = np.searchsorted(held_text, np.arange(rows + 1))
    once = np.full(rows + 1, len(pairs))
    once[0] = 0
    columns = [
        pa.array(np.full(rows, number, np.int64)),
        digests,
        copies,
        *[pa.array(np.diff(until, prepend=0)) for _, until in sides],
        pa.array(found.groups.astype(np.int64)),
        pa.array(n_links),
        pa.array(shas, pa.string()),
        _slices(held_at, bounds, pa.int32()),
        _slices(times, bounds, pa.int32()),
        _slices(pairs, once, pa.int64()),
        _slices(documents, once, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, text, copies) of the texts that are not empty, shuffled by full text after counting in each task."""
    known = docs.select(F.col(text).cast("string").alias("text")).filter("text <> ''")
    return known.groupBy("text").agg(F.count("*").alias("copies")).select(F.sha2("text", 256).alias("digest"), "text", "copies")


def align_texts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """ALIGNED rows, one per distinct text. Stored, as the batches have to stay the same."""
    target = arrow_schema(ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path_a, path_b)
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(pieces(batches, 1, BATCH)):
            yield _align_batch(coder, first + i, batch, target)

    return materialise(distinct_texts(docs, text).mapInArrow(run, ALIGNED))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, documents, best): in how many documents a pair is linked, and whether none of its A token's has more."""
    told = aligned.filter(F.size("pairs") > 0).select(F.explode(F.arrays_zip("pairs", "documents")).alias("p"))
    counts = told.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.documents").alias("documents"))
    # A token of A has at most as many pairs as B has tokens.
    most = F.max("documents").over(W.partitionBy(F.floor(F.col("pair") / size_b)))
    return counts.withColumn("best", F.col("documents") == most)


MEASURES = "digest string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def measured(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """MEASURES of every distinct text: the batches meet the counts of their pairs."""
    target = arrow_schema(MEASURES)
    told = aligned.filter(F.size("pairs") > 0).select(F.col("batch").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    counted = told.join(counts, "pair").select("of", "at", "documents", "best")

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        at = pairs.column("at").to_numpy()
        documents, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        documents[at] = pairs.column("documents").to_numpy()
        best[at] = pairs.column("best").to_numpy().astype(np.int64)
        lists = texts.column("pair_at").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        place = lists.flatten().to_numpy()
        times = texts.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(lengths)])

        def total(values: np.ndarray) -> pa.Array:
            sums = np.concatenate([[0], np.cumsum(values * times)])
            return pa.array(sums[edge[1:]] - sums[edge[:-1]])

        known = ("digest", "copies", "n_a", "n_b", "n_groups", "n_links")
        columns = [*[texts.column(c) for c in known], total(best[place]), total(documents[place]), texts.column("groups_sha256")]
        return pa.table([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    left = aligned.drop("pairs", "documents").groupBy("batch")
    return left.cogroup(counted.groupBy("of")).applyInArrow(run, MEASURES)


def to_rows(docs: DataFrame, measures: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures of every row of ``docs`` by its text; zeros where there are none.

    Texts of very many rows, of which there are few, are joined before the shuffle.
    """
    known = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("_key"), F.when(known != "", F.sha2(known, 256)).alias("digest"))
    names = [n for n in measures.columns if n not in ("digest", "copies")]
    copies = measures.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") * HOT_SHARE > copies
    values = F.struct(*names)
    few = measures.filter(hot).select("digest", values.alias("few"))
    rest = measures.filter(~hot).select(F.col("digest").alias("other"), values.alias("many"))
    met = rows.join(F.broadcast(few), "digest", "left")
    # Rows that have met their text, and those without any, go anywhere.
    spread = F.concat(F.lit("-"), F.xxhash64("_key").cast("string"))
    met = met.withColumn("_by", F.when(F.col("few").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(spread))
    both = F.coalesce("few", "many")
    return met.join(rest, F.col("_by") == F.col("other"), "left").select(
        F.col("_key").alias(key), *[F.coalesce(both[n], F.lit("" if n == "groups_sha256" else 0)).alias(n) for n in names]
    )


def alignment(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    aligned = align_texts(docs, path_a, path_b, text)
    counts = pair_counts(aligned, _pieces(path_b))
    return to_rows(docs, materialise(measured(aligned, counts)), key, text)


def _pieces(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
