"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

Encoding. A rank file gives each token's bytes and rank; of two neighbours, those whose joined
bytes have the least rank merge first. A sequence of tokens is what these merges make of its bytes
exactly if each pair of neighbours is what they make of that pair's bytes. So after each byte the
last token is unique: it is the token that ends there and goes with the last token where it starts.
A state holds the starts of tokens that may still be being read: each one's node in a trie of the tokens,
and the token before it, as long as it matters to which of the node's tokens may follow. A transition
gives the next state and the token that ends with its byte. Where a token starts is where the one before
it ends, so the tokens on the way to a place are found from there backwards; the ways to all starts of a
state part only within the last few tokens, and what they have in common is emitted. A token being read
is at most as long as the longest token, which bounds the lookahead. States and transitions are made when
first met and dropped together when there are too many.

Texts are split by the public GPT-2 pattern in numpy, equal pieces of a block are encoded once, and short
pieces are read in step: one byte of each at a time, with the transitions in an array of hash slots.

Decoding joins the tokens' bytes; a state machine over UTF-8 holds back a character until its last
byte has come, so that ids can be decoded as a stream.

Cases: null or empty text has no ids and decodes to empty text; null in `ids` decodes to empty text.
Ids outside the vocabulary raise ValueError. Rows that repeat are encoded each; order plays no part, so
ties can't arise. A text of any length is read whole, in one piece if it has one; a worker holds it and
its ids. An empty table gives one. Other columns are kept as they are; a column that has the name of
one to be added raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from featureflow.llm.common import chunks, in_worker, utf8, worker_tables
from featureflow.llm.wordvec import SHORT, lanes, run_hashes

#: Most transducer states, transitions and judged pairs of tokens in a worker. Those of one slice of pieces may come on top.
MOST_STATES, MOST_STEPS, MOST_PAIRS = 110_000, 220_000, 150_000
#: Longest piece that is read in step with others, and bytes of such pieces between looks at the limits.
SHORT_PIECE, SLICE_BYTES = 64, 1 << 17
#: Slots of the array of transitions (a power of two), and the multiplier that spreads keys over them.
SLOTS, SPREAD = 1 << 19, np.uint64(0x9E3779B97F4A7C15)
#: Characters of Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: A start is a trie node << ID_BITS | its last token + 1, or 0 at the beginning of a piece.
ID_BITS = 24
LAST = (1 << ID_BITS) - 1
#: Tokens below a trie node up to which they are looked at one by one before a start is kept.
FEW = 64
#: Bytes of a piece after which what is agreed on is emitted.
EMIT = 1024


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(ranks: dict[bytes, int], piece: bytes, least: int = 1) -> list[int]:
    """Merges applied one by one, the least rank first and the leftmost of equals, until `least` parts are left: the definition, used on single tokens and pairs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes in, ids out. `step` is the lazily filled transition table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.sizes[list(self.size)] = list(self.size.values())
        self.whole: dict[bytes, int] = {}  # tokens that merges don't make
        self.halves: dict[int, tuple[int, int]] = {}
        # A trie of the tokens that merges make of their own bytes; others can only stand for a whole piece.
        self.child: dict[int, int] = {}
        self.token, self.inner, self.depth = [-1], [True], [0]
        proper = True
        for b, i in ranks.items():
            if len(b) > 1:
                two = merge(ranks, b, 2)
                if len(two) != 2 or merge(ranks, b) != [i]:
                    self.whole[b] = i
                    continue
                self.halves[i] = two[0], two[1]
                proper &= all(h < i for h in two if h in self.halves or len(self.bytes[h]) > 1)
            self._add(b, i)
        # The tokens below a node, where they are few: a start that none of them can complete is given up.
        self.below: list[tuple[int, ...]] = [()] * len(self.token)
        above = {to: key >> 8 for key, to in self.child.items()}
        many = [False] * len(self.token)
        for node in range(len(self.token) - 1, 0, -1):  # children have higher numbers
            up, mine = above[node], self.below[node] + ((self.token[node],) if self.token[node] >= 0 else ())
            if many[node] or len(self.below[up]) + len(mine) > FEW:
                many[up], self.below[up] = True, ()
            elif not many[up]:
                self.below[up] += mine
        self.kept: dict[int, int] = {}
        self.goes = self._goes_back if proper else self._goes_by_merges
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _add(self, b: bytes, i: int) -> None:
        node = 0
        for byte in b:
            self.inner[node] = True
            to = self.child.get(node << 8 | byte)
            if to is None:
                to = self.child[node << 8 | byte] = len(self.token)
                self.token.append(-1)
                self.inner.append(False)
                self.depth.append(self.depth[node] + 1)
            node = to
        self.token[node] = i

    def _forget(self) -> None:
        self.names: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.step: dict[int, int] = {}
        self.slots = np.full((SLOTS, 2), -1, np.int64)  # the same transitions, as far as pieces in step have met them
        self._name((0,))

    def _name(self, state: tuple[int, ...]) -> int:
        at = self.names.get(state)
        if at is None:
            at = self.names[state] = len(self.states)
            self.states.append(state)
        return at

    def _goes_by_merges(self, a: int, b: int) -> bool:
        return merge(self.ranks, self.bytes[a] + self.bytes[b]) == [a, b]

    def _goes_back(self, a: int, b: int) -> bool:
        """The same, where a token's rank is above its halves': undo the merges of both sides, the last first.

        Between two merges the parts that touch are known; joining them would have come first if its
        rank is less than that of the merge undone (or equal, if that merge stood to the right).
        """
        name, ranks, halves, before = self.bytes, self.ranks, self.halves, 1 << 60
        while True:
            r = ranks.get(name[a] + name[b])
            if r is not None and r < before:
                return False
            ta, tb = a if a in halves else -1, b if b in halves else -1
            if ta > tb:
                a, before = halves[a][1], ta
            elif tb >= 0:
                b, before = halves[b][0], tb + 1
            else:
                return True

    def _narrow(self, node: int, last: int) -> int:
        """The start (node, last), without its last token if that goes with all tokens below the node, -1 if with none."""
        good = [self.goes(last - 1, t) for t in self.below[node]]
        if len(self.kept) > MOST_PAIRS:
            self.kept.clear()
        to = self.kept[node << ID_BITS | last] = -1 if not any(good) else node << ID_BITS | (0 if all(good) else last)
        return to

    def _advance(self, at: int, byte: int) -> int:
        """The transition: next state << ID_BITS | token that ends with the byte."""
        child, token, inner, pairs, below, kept, here, alive = self.child, self.token, self.inner, self.pairs, self.below, self.kept, -1, []
        for start in self.states[at]:
            now = child.get(start >> ID_BITS << 8 | byte)
            if now is None:
                continue
            last = start & LAST
            t = token[now]
            if here < 0 <= t:
                good = not last
                if last:
                    good = pairs.get(last << ID_BITS | t)
                    if good is None:
                        if len(pairs) > MOST_PAIRS:
                            pairs.clear()
                        good = pairs[last << ID_BITS | t] = self.goes(last - 1, t)
                if good:
                    here = t
            if inner[now]:
                if last and below[now]:
                    start = kept.get(now << ID_BITS | last)
                    if start is None:
                        start = self._narrow(now, last)
                    if start < 0:
                        continue
                    alive.append(start)
                else:
                    alive.append(now << ID_BITS | last)
        if here < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        alive.append(here + 1)
        to = self.step[at << 8 | byte] = self._name(tuple(alive)) << ID_BITS | here
        return to

    def _steps(self, keys: np.ndarray) -> np.ndarray:
        """Transitions of many (state << 8 | byte) at once."""
        slot = (keys.astype(np.uint64) * SPREAD >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        found = self.slots[slot]
        other = np.flatnonzero(found[:, 0] != keys)
        missing = []
        while len(other):
            free = found[other, 0] < 0
            missing.append(other[free])
            other = other[~free]
            slot[other] = slot[other] + 1 & SLOTS - 1
            found[other] = self.slots[slot[other]]
            other = other[found[other, 0] != keys[other]]
        if missing and len(lost := np.concatenate(missing)):
            new, first, back = np.unique(keys[lost], return_index=True, return_inverse=True)
            made = [self.step.get(k) or self._advance(k >> 8, k & 0xFF) for k in new.tolist()]
            for k, v, i in zip(new.tolist(), made, slot[lost[first]].tolist(), strict=True):
                while self.slots[i, 0] >= 0:
                    i = i + 1 & SLOTS - 1
                self.slots[i] = k, v
            found[lost, 1] = np.array(made, np.int64)[back]
        return found[:, 1]

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[start:end] one after another, and how many each has.

        Short pieces are read in step, the k-th byte of all at once; the token that ends with each byte
        is noted, and once a piece is read its tokens are picked from the last one backwards.
        """
        size = end - start
        count = np.zeros(len(start), np.int64)
        alone: list[tuple[int, list[int]]] = []
        singly = size > SHORT_PIECE
        if self.whole:
            fits = np.flatnonzero(np.isin(size, [len(b) for b in self.whole]))
            singly[[i for i, a, b in zip(fits.tolist(), start[fits].tolist(), end[fits].tolist(), strict=True) if data[a:b].tobytes() in self.whole]] = True
        for i in np.flatnonzero(singly).tolist():
            alone.append((i, self.encode(data[start[i] : end[i]].tobytes())))
            count[i] = len(alone[-1][1])
        order = np.flatnonzero(~singly)
        order = order[np.argsort(-size[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(np.cumsum(size[order]) // SLICE_BYTES)) + 1
        ends, picked = np.empty(len(data), np.int32), []
        for rows in np.split(order, cuts):
            if not len(rows):
                continue
            self._within_limits()
            at, n = start[rows], size[rows]
            state = np.zeros(len(rows), np.int64)
            for k, m in enumerate(np.searchsorted(-n, -np.arange(1, n[0] + 1), "right").tolist()):
                here = at[:m] + k
                to = self._steps(state[:m] << 8 | data[here])
                state[:m] = to >> ID_BITS
                ends[here] = to & LAST
            left, back = at + n, 0
            while len(rows):
                t = ends[left - 1]
                picked.append((rows, back, t))
                count[rows] += 1
                left = left - self.sizes[t]
                more = left > at
                rows, at, left, back = rows[more], at[more], left[more], back + 1
        past = np.cumsum(count)
        ids = np.empty(past[-1] if len(past) else 0, np.uint32)
        for rows, back, t in picked:
            ids[past[rows] - 1 - back] = t
        for i, one in alone:
            ids[past[i] - count[i] : past[i]] = one
        return ids, count

    def _within_limits(self) -> None:
        if len(self.states) > MOST_STATES or len(self.step) > MOST_STEPS:
            self._forget()

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of a split text."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        self._within_limits()
        at, out, ends, step = 0, [], [], self.step
        for byte in piece:
            to = step.get(at << 8 | byte)
            if to is None:
                to = self._advance(at, byte)
            at = to >> ID_BITS
            ends.append(to & LAST)
            if len(ends) >= EMIT:
                out += self._agreed(ends, {len(ends) - self.depth[x >> ID_BITS] for x in self.states[at]})
        return out + self._agreed(ends, {len(ends)})

    def _agreed(self, ends: list[int], starts: set[int]) -> list[int]:
        """Tokens up to the last place that the ways to all of `starts` have in common; they are taken off `ends`, the token that ends with each byte."""
        size = self.size
        while len(starts) > 1:
            last = max(starts)
            starts.remove(last)
            starts.add(last - size[ends[last - 1]])
        (at,) = starts
        cut, out = at, []
        while at > 0:
            out.append(ends[at - 1])
            at -= size[out[-1]]
        del ends[:cut]
        return out[::-1]


class Utf8Machine:
    """Incremental UTF-8: feed() returns the characters that are complete; invalid bytes become U+FFFD."""

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                least, most = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not least <= data[1 - back] <= most:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        cut = len(data) - self._open(data)
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


_shared: dict[str, np.ndarray] = {}


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets where the pieces of the texts data[offsets[i]:offsets[i + 1]] start.

    The pattern's pieces: a contraction 's 't 're 've 'm 'll 'd; a run of letters, of numbers or of
    other signs, each with one space before it; white space but its last character before a run.
    """
    if "classes" not in _shared:
        _shared["classes"] = _classes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return lead
    code = data[lead].astype(np.int32)
    if len(lead) < len(data):
        many = np.flatnonzero(code >= 0xC0)
        at, c = lead[many], code[many]
        size = 2 + (c >= 0xE0) + (c >= 0xF0)
        value = c & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            has = size > k
            value[has] = (value[has] << 6) | (data[at[has] + k] & 0x3F)
        code[many] = value
    kind = _shared["classes"][code]
    n = len(lead)
    text_start = np.zeros(n + 1, bool)
    text_start[np.searchsorted(lead, offsets)] = True
    change = text_start[:n].copy()
    change[0] = True
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    is_space = kind[run] == SPACE
    followed = ~text_start[end]  # by another run of the same text
    starts = np.zeros(n + 1, bool)
    starts[run[~is_space]] = True
    starts[run[is_space & (~followed | (end - run > 1))]] = True
    cut = np.flatnonzero(is_space & followed)
    starts[end[cut] - 1] = True
    joins = cut[code[end[cut] - 1] == 0x20]  # a space that goes with the run after it
    starts[end[joins]] = False
    quote = np.flatnonzero(~is_space & followed & (end - run == 1) & (code[run] == 0x27) & starts[run])
    quote = quote[kind[end[quote]] == LETTER]
    if len(quote):
        a = end[quote]
        last = np.append(end, n)[quote + 1]
        c0, c1 = code[a], np.where(a + 1 < last, code[np.minimum(a + 1, n - 1)], 0)
        one = np.isin(c0, [ord(x) for x in "stmd"])
        two = ((c1 == ord("e")) & ((c0 == ord("r")) | (c0 == ord("v")))) | ((c0 == ord("l")) & (c1 == ord("l")))
        took = np.where(one, 1, np.where(two, 2, 0))
        hit = took > 0
        starts[a[hit]] = False
        starts[(a + took)[hit]] = True
    return lead[starts[:n]]


def _equal_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of each group of pieces data[start:end] with equal bytes, and each piece's group: hashes propose groups, the bytes decide."""
    _, first, back = np.unique(run_hashes(data, start, end), return_index=True, return_inverse=True)
    size, of = end - start, first[back]
    low, high = lanes(data, start, size)
    same = (size == size[of]) & (low == low[of]) & (high == high[of])
    long = np.flatnonzero(same & (size > SHORT) & (of != np.arange(len(of))))
    raw = data.tobytes() if len(long) else b""
    for i, a, b, x in zip(long.tolist(), start[long].tolist(), end[long].tolist(), start[of[long]].tolist(), strict=True):
        same[i] = raw[a:b] == raw[x : x + b - a]
    other = np.flatnonzero(~same)  # a group of its own each
    back[other] = len(first) + np.arange(len(other))
    return np.concatenate([first, other]), back


class Codec:
    """Batches of texts to ids and back."""

    def __init__(self, rank_file: bytes):
        ranks = read_ranks(rank_file)
        self.transducer = Transducer(ranks)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            tokens[i] = b
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.from_ = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and n + 1 offsets into them."""
        start = split(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        first, back = _equal_pieces(data, start, end)
        flat, size = self.transducer.encode_pieces(data, start[first], end[first])
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        count = size[back]
        total = np.concatenate([[0], np.cumsum(count)])
        out = flat[np.arange(total[-1]) + np.repeat(at[back] - total[:-1], count)]
        return out, total[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and int(ids.max()) >= len(self.size):
            raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
        count = self.size[ids]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.blob[np.arange(total[-1]) + np.repeat(self.from_[ids] - total[:-1], count)].tobytes()

    def stream(self, ids: np.ndarray, step: int = 65_536) -> Iterator[str]:
        """The text of ids, a step at a time, in whole characters."""
        machine = Utf8Machine()
        for a in range(0, len(ids), step):
            yield machine.feed(self.decode(ids[a : a + step]))
        yield machine.finish()


def codec(rank_file: bytes) -> Codec:
    """The codec of a rank file, compiled once in each worker and kept until another operator's task comes."""
    kept, key = worker_tables("bpe"), hashlib.sha256(rank_file).digest()
    if kept.get("key") != key:
        kept.update(key=key, codec=Codec(rank_file))
    return kept["codec"]


def _encoded(column: pa.Array, c: Codec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = utf8(column)
    for a, b in chunks(off):
        yield a, b, *c.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _mapped(df: DataFrame, added: dict[str, T.DataType], rank_path: str, make: Callable[[pa.RecordBatch, Codec], Iterator[list[pa.Array]]]) -> DataFrame:
    with open(rank_path, "rb") as f:
        ranks = f.read()
    if clash := set(added) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are already there")
    names = [*df.columns, *added]

    @in_worker("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            for columns in make(batch, c):
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType(list(df.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, rank_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with `ids` array<int> added; rank_path is a rank file on the driver."""
    place = df.columns.index(text)

    def make(batch: pa.RecordBatch, c: Codec) -> Iterator[list[pa.Array]]:
        for a, b, out, off in _encoded(batch.column(place), c):
            yield [x.slice(a, b - a) for x in batch.columns] + [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(out.astype(np.int32)))]

    return _mapped(df, {ids: T.ArrayType(T.IntegerType())}, rank_path, make)


def decode(df: DataFrame, rank_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids added."""
    place = df.columns.index(ids)

    def make(batch: pa.RecordBatch, c: Codec) -> Iterator[list[pa.Array]]:
        texts = ["".join(c.stream(np.asarray(x.values, np.int64))) if x.is_valid else "" for x in batch.column(place)]
        yield [*batch.columns, pa.array(texts, pa.string())]

    return _mapped(df, {text: T.StringType()}, rank_path, make)


def round_trip(df: DataFrame, rank_path: str) -> DataFrame:
    """df (doc_id, text) -> doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 (of the bytes the stream decoder gives back)."""

    def make(batch: pa.RecordBatch, c: Codec) -> Iterator[list[pa.Array]]:
        for a, b, out, off in _encoded(batch.column(1), c):
            out = out.astype("<u4")
            n, of_ids, of_text = [], [], []
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                one, seen = out[i:j], hashlib.sha256()
                for part in c.stream(one):
                    seen.update(part.encode())
                n.append(j - i)
                of_ids.append(hashlib.sha256(one.tobytes()).hexdigest())
                of_text.append(seen.hexdigest())
            yield [x.slice(a, b - a) for x in batch.columns[:1]] + [pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)]

    with open(rank_path, "rb") as f:
        ranks = f.read()

    @in_worker("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            for columns in make(batch, c):
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
