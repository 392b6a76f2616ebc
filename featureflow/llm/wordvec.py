"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, as 64-bit hashes in numpy arrays.

A run of up to 16 bytes is read as two 64-bit numbers and its length, which are mixed into its hash;
longer runs, of which a text can't have many, go through xxHash one by one. So equal hashes mean equal
bytes up to the odds of a good 64-bit hash, for texts of any structure. Separators are ASCII, so
bytes split where characters do. A text or table without words gives empty arrays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of a run that `lanes` holds.
SHORT = 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@lru_cache(1)
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@lru_cache(1)
def _separator() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SEPARATORS)] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each run data[start:start + size] as two numbers, 0 beyond its end."""
    padded = np.zeros(len(data) + SHORT, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    return eight[start] & _MASKS[np.minimum(size, 8)], eight[start + 8 * (size > 8)] & _MASKS[np.clip(size - 8, 0, 8)]


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run data[start:end]."""
    size = end - start
    low, high = lanes(data, start, size)
    h = mix(mix(low ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + high * np.uint64(0xA0761D6478BD642F))
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw, one = data.tobytes(), xxhash.xxh3_64_intdigest
        h[long] = np.fromiter((one(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return h


@dataclass
class Words:
    start: np.ndarray  # byte offset of each word in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n + 1: index of each text's first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]; lower: A-Z count as a-z."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    gap = _separator()[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    h = run_hashes(_lower()[data] if lower else data, start, end)
    return Words(start, end, h, np.searchsorted(start, offsets))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and the n + 1 index of each text's first run."""
    counts = np.maximum(w.counts - (size - 1), 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], counts)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = h * np.uint64(0xA24BAED4963EE407) + w.hash[at + k]
    return mix(h), first


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct runs of `size` words; all its words as one run where it has fewer; empty without words."""
    h, first = windows(w, size)
    counts, out = w.counts, []
    for i in range(len(counts)):
        if counts[i] >= size:
            out.append(np.unique(h[first[i] : first[i + 1]]))
        elif counts[i]:
            one = np.full(1, counts[i], np.uint64)
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                one = one * np.uint64(0x8CB92BA72F3D8DD7) + x
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
