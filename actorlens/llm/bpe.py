"""Byte-level BPE encoding and decoding in linear time.

The vocabulary is a rank file (base64 token, rank). Bytes become Latin-1 characters, so that an
Aho-Corasick automaton over strings finds the longest token at every position in one pass. The
encoder starts from longest matches and goes back to shorter ones where two neighbours could not
stand side by side in a merged text; whether they can depends on the two tokens only and is
remembered. The result equals applying the merges by rank.

Defined cases: a null or empty text has no tokens and decodes to no bytes; rows that repeat are
encoded each; extra columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from actorlens.llm.arrow import arrow_schema, id_and_text, key_type, pieces

#: Entries a worker remembers of each kind; a full memory is emptied.
REMEMBERED = 600_000


class _PieceIds(dict):
    """UTF-8 piece text -> its ids as int32 bytes."""

    def __init__(self, encode_bytes):
        super().__init__()
        self.encode_bytes = encode_bytes

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encode_bytes(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.size = max(self.tokens, default=-1) + 1
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: Longest token that is a proper prefix of the token.
        self.shorter = {rank: self._longest_prefix(token) for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.together: dict[int, bool] = {}
        self._find_last_merges()
        self.ids_of_piece = _PieceIds(self.encode_bytes)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def _longest_prefix(self, token: bytes) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return None

    def _find_last_merges(self) -> None:
        """The two tokens whose merge makes each token, lower ranks first; none for base tokens."""
        for rank in sorted(self.tokens):
            token, left = self.tokens[rank], self.shorter[rank]
            while left is not None:
                right = self.ranks.get(token[len(self.tokens[left]) :])
                if right is not None and left < rank and right < rank and self._stand_together(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
                left = self.shorter[left]
        self.together.clear()  # what was seen while merges were still missing

    def can_follow(self, left: int, right: int) -> bool:
        """Whether the tokens can be neighbours; the answer is remembered."""
        if len(self.together) >= REMEMBERED:
            self.together.clear()
        known = self.together[left * self.size + right] = self._stand_together(left, right)
        return known

    def _stand_together(self, left: int, right: int) -> bool:
        """True if no merge across the border comes before the merges that made both tokens.

        Undo the later of the last merges on either side, one at a time, and look for a merge of
        the two tokens then at the border that would have come earlier.
        """
        limit = self.size
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                token = left if undo_left else right
                made = self.parts.get(token)
                if made is not None:
                    if undo_left:
                        limit, left = token, made[1]
                    else:
                        limit, right = token + 1, made[0]
                    break
                undo_left = not undo_left
            else:
                return True

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        lengths, shorter, together, size = self.lengths, self.shorter, self.together, self.size
        end = len(piece)
        longest = [0] * end  # rank of the longest token at every position
        for last_byte, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[last_byte + 1 - lengths[rank]] = rank  # later ends are longer
        position, previous, ids = 0, -1, []
        no_border = set()
        token: int | None = longest[0] if end else None
        while token is not None:
            after = position + lengths[token]
            fits = after not in no_border
            if fits and previous >= 0:
                fits = together.get(previous * size + token)
                if fits is None:
                    fits = self.can_follow(previous, token)
            if fits:
                ids.append(token)
                previous, position = token, after
                token = longest[position] if position < end else None
            else:
                token = shorter[token]
                while token is None:  # nothing fits here: this position is no border
                    no_border.add(position)
                    last = ids.pop()
                    position -= lengths[last]
                    previous = ids[-1] if ids else -1
                    token = shorter[last]
        return ids

    def encode(self, text: str) -> np.ndarray:
        ids = self.ids_of_piece
        return np.frombuffer(b"".join([ids[piece] for piece in self.split(text)]), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> BytePairs:
    """One coder per worker process."""
    return BytePairs.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each row's whole text. The rank file is read by every executor."""
    schema = f"`{key}` {key_type(docs, key)}, ids array<int>"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for batch in pieces(batches):
            found = [coder.encode(value) for value in batch.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(ids) for ids in found], out=offsets[1:])
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(target.field(0).type), ids.cast(target.field(1).type)], schema=target
            )

    return id_and_text(docs, key, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the bytes of each row's ids next to the ids."""
    schema = f"`{key}` {key_type(encoded, key)}, ids array<int>, decoded binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = part.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False).tolist()
                at, texts = 0, []
                for length in pc.list_value_length(lists).to_pylist():
                    texts.append(coder.decode(values[at : at + (length or 0)]))
                    at += length or 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists.cast(target.field(1).type), pa.array(texts, pa.binary())], schema=target
                )

    return encoded.select(key, encoded[ids].alias("ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of each row's whole text by one coder: a worker that encodes and decodes holds one vocabulary."""
    schema = f"`{key}` {key_type(docs, key)}, ids array<int>, decoded binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for batch in pieces(batches, 1, 2 << 20):
            found = [coder.encode(value).tolist() for value in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(found, target.field(1).type), pa.array([coder.decode(ids) for ids in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return id_and_text(docs, key, text).mapInArrow(run, schema)
