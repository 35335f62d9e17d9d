"""Words of whole Arrow batches as numbers, found with array operations on their bytes.

Words are the maximal runs of bytes other than [\\x20\\x09-\\x0D]. A word's hash is a polynomial
of its bytes (A-Z as a-z, all others as they are) in 64-bit arithmetic, mixed afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer word extends a part.
PART = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DRAWN = np.random.default_rng(20240229)
_VALUES = _DRAWN.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_BASE, *_PLACES = (int(x) | 1 for x in _DRAWN.integers(1, 1 << 63, 9, dtype=np.uint64))
_POWERS = [np.ones(1, np.uint64)]


def _powers(length: int) -> np.ndarray:
    """_BASE to the powers 0..length-1, in a table that grows with the longest word seen."""
    if len(_POWERS[0]) < length:
        table = np.full(2 * length, _BASE, np.uint64)
        table[0] = 1
        _POWERS[0] = np.cumprod(table, dtype=np.uint64)
    return _POWERS[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers whose leading bits are as good as its last ones."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@dataclass
class Words:
    """``hashes``, ``lengths`` in bytes and ``last`` bytes of all words; row i has bounds[i]:bounds[i + 1]."""

    hashes: np.ndarray
    lengths: np.ndarray
    last: np.ndarray
    bounds: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the rows' bounds in them."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or buffers[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _part(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, hashes, lengths and last bytes of the words of some bytes; words also end at ``cuts``."""
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inside = cuts[cuts < len(data)]
    start[inside] = word[inside]
    starts = np.flatnonzero(start)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty.astype(np.uint8)
    end = word.copy()
    end[:-1] &= ~word[1:] | start[1:]
    ends = np.flatnonzero(end) + 1
    lengths = ends - starts
    flat = data[word]
    begins = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=begins[1:])
    places = np.arange(len(flat)) - np.repeat(begins, lengths)
    terms = _VALUES[flat] * _powers(int(lengths.max()))[places]
    sums = np.add.reduceat(terms, begins)
    return starts, mixed(sums + lengths.astype(np.uint64)), lengths, data[ends - 1]


def words(column: pa.Array) -> Words:
    """All words of a string column without nulls."""
    data, bounds = text_bytes(column)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + PART)
        # A part ends after white space or at a row's end, so that no word is cut.
        while end < len(data):
            stops = np.flatnonzero(_SPACE[data[at:end]])
            row_end = bounds[np.searchsorted(bounds, end, "right") - 1]
            best = max(at + int(stops[-1]) + 1 if len(stops) else at, int(row_end))
            if best > at:
                end = best
                break
            end = min(len(data), end + PART)
        cuts = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)] - at
        starts, *rest = _part(data[at:end], cuts)
        found.append((starts + at, *rest))
        at = end
    if not found:
        return Words(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8), np.zeros(len(bounds), np.int64))
    starts, hashes, lengths, last = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(hashes, lengths, last, np.searchsorted(starts, bounds))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words (8 at most); of fewer words, one of the whole run."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    actual = min(width, len(hashes))
    count = len(hashes) - actual + 1
    total = np.full(count, actual, np.uint64)
    for i in range(actual):
        total += hashes[i : i + count] * np.uint64(_PLACES[i])
    return mixed(total)
