"""Token counts of many texts at once, in numpy and Arrow: the tokens of functions.text, without a row or an object a token.

Texts are taken in slices of SLICE_BYTES, so memory doesn't grow with a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts, and entries of vectors, that are worked on at once (one text at least).
SLICE_BYTES, SLICE_ENTRIES = 4 << 20, 1 << 18

PACKED = "struct<at: binary, n: binary, rest: array<struct<k: string, n: int>>>"
VECTOR = "struct<indices: array<int>, values: array<double>>"


@lru_cache(1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """By byte: whether it is white space, and whether white space of several bytes may start with it."""
    space, lead = np.zeros(256, bool), np.zeros(256, bool)
    space[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    return space, lead


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to Unicode white space."""
    space, lead = _bytes()
    out = space[data]
    at = np.flatnonzero(lead[data])
    if len(at):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = padded[at], padded[at + 1], padded[at + 2]
        two = at[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = at[((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (general | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
        out[two] = out[two + 1] = True
        out[three] = out[three + 1] = out[three + 2] = True
    return out


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to `most`, or of one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, end
        start = end


def _texts(texts: pa.Array) -> Iterator[pa.Array]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for start, end in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
        yield texts.slice(start, end - start)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each token its text's number and its word's; and the words. Of large_string without null."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    blank = white(data)
    inside = ~blank
    first, last = np.empty(len(data) + 1, bool), np.empty(len(data) + 1, bool)
    first[0], first[1:] = True, blank
    last[-1], last[:-1] = True, blank
    first[at] = last[at] = True  # texts are apart
    start = np.flatnonzero(first[:-1] & inside)
    end = np.flatnonzero(last[1:] & inside) + 1
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
    tokens = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = tokens.dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, at)))
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value: texts) -> (value, have): of some texts' words, how many of these texts have them; a word comes in several rows."""
    for batch in batches:
        for texts in _texts(batch.column(0)):
            row, code, known = words(texts)
            once = np.unique(row * len(known) + code)
            have = np.bincount(once % max(1, len(known)), minlength=len(known))
            yield pa.RecordBatch.from_arrays([known.cast(pa.string()), pa.array(have, pa.int64())], ["value", "have"])


def _lists(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)])


def _binary(items: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets * np.int32(4)), pa.py_buffer(items.astype("<i4"))])


def packed(head: pa.Array) -> Callable[[pa.Array], pa.Array]:
    """Texts -> PACKED: places in `head` and counts as 32-bit numbers, in order of places, and the words that aren't there with their counts."""
    head = head.cast(pa.large_string())

    def part(texts: pa.Array) -> pa.Array:
        row, code, known = words(texts)
        place = pc.fill_null(pc.index_in(known, value_set=head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.where(place < 0, len(head) + np.arange(len(known)), place)
        width = max(1, len(head) + len(known))
        key, n = np.unique(row * width + place[code], return_counts=True)
        row, place = key // width, key % width
        inside = place < len(head)
        of = lambda which: _lists(np.bincount(row[which], minlength=len(texts)))
        rest = pa.StructArray.from_arrays([known.take(pa.array(place[~inside] - len(head))).cast(pa.string()), pa.array(n[~inside], pa.int32())], ["k", "n"])
        at = of(inside)
        columns = [_binary(place[inside], at), _binary(n[inside], at), pa.ListArray.from_arrays(pa.array(of(~inside)), rest)]
        return pa.StructArray.from_arrays(columns, ["at", "n", "rest"])

    def pack(texts: pa.Array) -> pa.Array:
        parts = [part(t) for t in _texts(texts)]
        return pa.concat_arrays(parts) if parts else part(texts.cast(pa.large_string()))

    return pack


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of binaries without null, and how many each has."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].copy().view("<i4"), np.diff(at) // 4


def filled(pos: np.ndarray, weight: np.ndarray, binary: bool) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """Places and counts of `packed`, and list<struct<to, n, w>> of what the rest was found to be -> VECTOR, by position; pos and weight are the head's."""

    def part(at: pa.Array, n: pa.Array, rest: pa.Array) -> pa.Array:
        (place, sizes), (count, _) = _numbers(at), _numbers(n)
        found = rest.flatten()
        more = pc.fill_null(pc.list_value_length(rest), 0).to_numpy(zero_copy_only=False)
        column = lambda name: found.field(name).to_numpy(zero_copy_only=False)
        rows = np.arange(len(at))
        where = np.concatenate([pos[place], column("to")])
        count, w = np.concatenate([count, column("n")]), np.concatenate([weight[place], column("w")])
        if more.any():
            order = np.argsort(np.concatenate([np.repeat(rows, sizes), np.repeat(rows, more)]) * (1 << 32) + where)
            where, count, w = where[order], count[order], w[order]
        value = w if binary else count * w
        offsets = pa.array(_lists(sizes + more))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(where, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(value, pa.float64()))], ["indices", "values"])

    def fill(at: pa.Array, n: pa.Array, rest: pa.Array) -> pa.Array:
        at, n = (pc.fill_null(c.cast(pa.large_binary()), b"") for c in (at, n))
        sizes = pc.binary_length(at).to_numpy(zero_copy_only=False) // 4 + pc.fill_null(pc.list_value_length(rest), 0).to_numpy(zero_copy_only=False)
        parts = [part(*(c.slice(a, b - a) for c in (at, n, rest))) for a, b in slices(sizes, SLICE_ENTRIES)]
        return pa.concat_arrays(parts) if parts else part(at, n, rest)

    return fill
