"""Near-duplicate documents by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set holds its distinct word shingles. Documents with equal sets form a class at once.
Each class gets a sketch of minima from one permutation, whose empty bins borrow from full ones
(optimal densification); `bands` keys of `rows` bins each put it into buckets. Candidates are
checked on full sets, in steps that together cover every pair that shares a bucket:

1. star: each member of a bucket against the bucket's smallest member, one pair a member;
2. trees: buckets whose members are in different components by then are compared in blocks, on all
   hashes of their sets cut to 16 bits. Cut hashes can only add to an intersection, so the pairs that
   still reach the threshold hold all links. Of those in a block, only as many as join its components
   to trees go on to the check; some members of the first block are in every block and join the blocks;
3. rest: where components still differ, all such pairs of different components go on to the check.

Pairs inside a component need no check, since only components are asked for. A pair at similarity
0.85 shares no bucket with probability (1 - 0.85^5)^24 < 1e-6; all that share one are covered.

Cases: null or empty text, or text without words, has an empty set and is linked with nothing.
A null doc_id takes no part (component_id null, kept true). Repeated rows are copies of each other.
Texts of any length are read whole. Of equal candidates for a centre the least doc_id is taken. A doc_id is an integer
or a string; others raise TypeError. An empty table gives none. Other columns are ignored, or kept by
`deduplicate`, which refuses one named _gone.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import BROADCAST_BYTES, chunks, drop, in_worker, int_list, materialise, utf8
from featureflow.llm.graph import components
from featureflow.llm.wordvec import mix, shingle_sets, words

#: Members of a bucket, and hashes of their sets, that one step of the rest compares with as many others.
BLOCK, BLOCK_HASHES = 2048, 1 << 19
#: Members of a bucket's first block that are added to its other blocks.
SHARED = 64


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    percent: int = 85  # linked if 100 * intersection >= percent * union
    bands: int = 24
    rows: int = 5
    seed: int = 1

    @property
    def bins(self) -> int:
        return self.bands * self.rows


class Sketcher:
    """Sketches and band keys of sorted sets of 64-bit hashes."""

    def __init__(self, p: Params, attempts: int = 4096):
        self.p = p
        draw = np.random.default_rng(p.seed)
        self.at = draw.integers(0, p.bins, (attempts, p.bins))
        self.weights = draw.integers(1, 2**63, p.rows, dtype=np.uint64) | np.uint64(1)
        self.salt = draw.integers(1, 2**63, p.bands, dtype=np.uint64)

    def sketch(self, s: np.ndarray) -> np.ndarray:
        """The least hash in each bin; an empty bin takes that of the first full bin in its own random sequence."""
        k = self.p.bins
        out, full = np.zeros(k, np.uint64), np.zeros(k, bool)
        if not len(s):
            return out
        which = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # grows with the hash, so the first of a bin is its least
        lead = np.concatenate([[True], which[1:] != which[:-1]])
        out[which[lead]] = s[lead]
        full[which[lead]] = True
        empty, a = np.flatnonzero(~full), 0
        for b in (8, 64, len(self.at)):
            if not len(empty):
                return out
            hit = full[self.at[a:b, empty]]
            found = hit.any(0)
            to = empty[found]
            out[to] = out[self.at[a + hit.argmax(0)[found], to]]
            empty, a = empty[~found], b
        if len(empty):
            have = np.flatnonzero(full)
            out[empty] = out[have[np.searchsorted(have, empty) % len(have)]]
        return out

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        b = sketches.reshape(len(sketches), self.p.bands, self.p.rows)
        return mix((b * self.weights).sum(2, dtype=np.uint64) + self.salt).view(np.int64)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, off = utf8(column)
    for a, b in chunks(off):
        yield a, b, shingle_sets(words(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True), size)


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, cls (key of the set), keys (of the bands)."""

    @in_worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(p)
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), p.shingle):
                full = np.stack([sketcher.sketch(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), int_list(sketcher.keys(full), pa.int64())],
                    ["doc_id", "n_shingles", "cls", "keys"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, cls binary, keys array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets reach the threshold."""

    @in_worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            good = []
            for lo, hi, right in _sets(batch.column(3), p.shingle):
                for i in range(lo, hi):
                    key = a[i].as_py()
                    if key != last[0]:
                        last = key, next(_sets(batch.column(2).slice(i, 1), p.shingle))[2][0]
                    x, y = last[1], right[i - lo]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= p.percent * (len(x) + len(y) - both):
                        good.append(i)
            if good:
                yield pa.RecordBatch.from_arrays([a.take(pa.array(good)), b.take(pa.array(good))], ["a", "b"])

    right = pairs.join(texts.withColumnsRenamed({"cls": "b", "text": "text_b"}), "b")
    both = right.join(texts.withColumnsRenamed({"cls": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary")


def _cut(texts: DataFrame, p: Params) -> DataFrame:
    """texts (cls, text) -> cls, n (size of the set), low (its hashes, cut to 16 bits)."""

    @in_worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), p.shingle):
                low = [(x >> np.uint64(40)).astype(np.uint16).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(low, pa.binary())], ["cls", "n", "low"])

    return texts.select("cls", "text").mapInArrow(run, "cls binary, n long, low binary")


class _Side:
    """Members of a bucket's block: names, roots, set sizes and cut hashes one after another."""

    def __init__(self, rows: pa.StructArray):
        self.cls, self.root = rows.field("cls").to_pylist(), rows.field("root").to_pylist()
        self.n = np.asarray(rows.field("n"))
        self.low = [np.frombuffer(x, np.uint16) for x in rows.field("low").to_pylist()]
        self.all = np.concatenate(self.low)
        self.first = np.concatenate([[0], np.cumsum(self.n)])[:-1]

    def reach(self, x: np.ndarray, seen: np.ndarray, percent: int) -> np.ndarray:
        """Members whose cut intersection with x reaches the threshold; seen: a false table of 2^16."""
        seen[x] = True
        both = np.add.reduceat(seen[self.all].astype(np.int32), self.first)
        seen[x] = False
        return np.flatnonzero(100 * both >= percent * (len(x) + self.n - both))


def _close(blocks: DataFrame, p: Params, trees: bool) -> DataFrame:
    """Blocks (left, right: arrays of (cls, root, n, low); right null: left) -> pairs (a, b) of different roots that may reach the threshold.

    trees: only as many pairs of each row as join its roots where they can be joined.
    """

    @in_worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, bool)
        for batch in batches:
            for i in range(len(batch)):
                left = _Side(batch.column(0)[i].values)
                right = _Side(batch.column(1)[i].values) if batch.column(1)[i].is_valid else left
                # Members of the commonest root needn't be compared with each other, so the others look for partners.
                common = Counter(left.root + right.root).most_common(1)[0][0]
                joined: dict[bytes, bytes] = {}

                def top(r: bytes, joined: dict[bytes, bytes] = joined) -> bytes:
                    while (up := joined.get(r, r)) != r:
                        joined[r] = joined.get(up, up)
                        r = up
                    return r

                out = set()
                for one, other in ((left, right), (right, left))[: 1 if right is left else 2]:
                    for k, root in enumerate(one.root):
                        if root != common:
                            for j in other.reach(one.low[k], seen, p.percent).tolist():
                                if other.root[j] != root:
                                    if trees:
                                        x, y = top(root), top(other.root[j])
                                        if x == y:
                                            continue
                                        joined[x] = y
                                    out.add((min(one.cls[k], other.cls[j]), max(one.cls[k], other.cls[j])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([z[0] for z in out], pa.binary()), pa.array([z[1] for z in out], pa.binary())], ["a", "b"])

    return blocks.mapInArrow(run, "a binary, b binary")


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, n_blocks, cls, root) of the buckets whose members are in different components."""
    placed = shared.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n_shingles", F.coalesce("root", "cls").alias("root"))
    placed = materialise(placed, "placed")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_HASHES)).cast("int")
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), blocks.alias("n_blocks")).filter("x <> y").select("key", "n_blocks")
    mixed = materialise(mixed, "mixed")
    out = materialise(placed.join(mixed, "key").select("key", "n_blocks", "cls", "root"), "open")
    drop(placed, mixed)
    return out


def _blocks(members: DataFrame, cut: DataFrame) -> DataFrame:
    """(key, n_blocks, block, m): the members of each bucket in blocks."""
    block = F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int")
    member = F.struct("cls", "root", "n", "low").alias("m")
    return materialise(members.join(cut, "cls").groupBy("key", "n_blocks", block.alias("block")).agg(F.collect_list(member).alias("m")), "blocks")


def _named(doc_id: Column, cls: Column, kind: str) -> Column:
    """A class's name: its smallest doc_id so that bytes are in the order of ids, then its key."""
    if kind == "string":
        return F.concat(doc_id.cast("binary"), F.unhex(F.lit("00")), cls)
    return F.concat(F.unhex(F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), cls)


def _id_of(name: Column, kind: str) -> Column:
    if kind == "string":
        return F.substring(name, F.lit(1), F.length(name) - 17).cast("string")
    return F.conv(F.hex(F.substring(name, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63))).cast(kind)


def near_duplicates(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is it), one row a document."""
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("string", "bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id must be an integer or a string, not {kind}")
    drawn = materialise(sketches(docs, p), "sketches")
    able = drawn.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Columns of a class depend on its set alone, so any row's will do.
    classes = materialise(able.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "classes")
    one = able.join(classes, ["doc_id", "cls"], "left_semi").dropDuplicates(["cls"])
    # From here on `cls` is a class's name, so that the least name of a component holds its least doc_id.
    members = one.select(_named(F.col("doc_id"), F.col("cls"), kind).alias("cls"), "n_shingles", F.explode("keys").alias("key"))
    # A table of its own, so that the join that follows can split a bucket with many members.
    buckets = materialise(members.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("centre")).filter("n > 1").drop("n"), "centres")
    shared = materialise(members.join(buckets, "key"), "buckets")

    stars = shared.filter("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    wanted = materialise(shared.select("cls").distinct().withColumn("doc_id", _id_of(F.col("cls"), kind)), "wanted")
    few = wanted.agg(F.count("*") * 24 + F.coalesce(F.sum(F.length("cls") + F.length(F.col("doc_id").cast("string"))), F.lit(0))).first()[0] <= BROADCAST_BYTES
    texts = materialise(docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "cls", "text"), "texts")
    texts = _own(texts, p) if _repeated(texts) else texts.select("cls", "text")
    links = materialise(_verify(stars, texts, p), "links")

    open_ = _open(shared, materialise(components(links), "roots"))
    cut = materialise(_cut(texts.join(open_.select("cls").distinct(), "cls", "left_semi"), p), "cut")
    grouped = _blocks(open_, cut)
    some = grouped.filter("block = 0 AND n_blocks > 1").select("key", F.slice("m", 1, SHARED).alias("some"))
    whole = grouped.join(some, "key", "left").select(F.when((F.col("block") > 0) & F.col("some").isNotNull(), F.concat("m", "some")).otherwise(F.col("m")).alias("left"))
    trees = _close(whole.select("left", F.when(F.lit(False), F.col("left")).alias("right")), p, trees=True).distinct()
    links = materialise(links.unionByName(_verify(trees, texts, p)), "links")
    drop(grouped, open_)

    roots = materialise(components(links), "roots")
    open_ = _open(shared, roots)
    grouped = _blocks(open_, cut)
    left = grouped.withColumn("to", F.explode(F.sequence("block", F.col("n_blocks") - 1)))
    right = grouped.select("key", F.col("block").alias("to"), F.col("m").alias("right"))
    rest = _close(left.join(right, ["key", "to"]).select(F.col("m").alias("left"), F.when(F.col("block") != F.col("to"), F.col("right")).alias("right")), p, trees=False).distinct()
    more = materialise(_verify(rest, texts, p), "links")
    drop(grouped, open_, cut, texts, shared, buckets, wanted)
    if not more.isEmpty():
        roots = materialise(components(links.unionByName(more)), "roots")
    named = classes.withColumn("node", _named(F.col("doc_id"), F.col("cls"), kind)).join(roots, "node", "left")
    ids = named.select("cls", _id_of(F.coalesce("root", "node"), kind).alias("component_id"))
    found = drawn.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).cast(kind)
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeated(texts: DataFrame) -> bool:
    return bool(texts.groupBy("doc_id").count().filter("count > 1").limit(1).count())


def _own(texts: DataFrame, p: Params) -> DataFrame:
    """Where a doc_id comes with several texts: those rows whose text has the class's set, one a class."""

    @in_worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            good = [i for a, b, sets in _sets(batch.column(1), p.shingle) for i in range(a, b) if digest(sets[i - a]) == keys[i][-16:]]
            yield batch.take(pa.array(good, pa.int64()))

    return materialise(texts.select("cls", "text").mapInArrow(run, "cls binary, text string").dropDuplicates(["cls"]), "texts")


def deduplicate(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents without near duplicates: one document of each component stays, with all its columns.

    A repeated row, having the same doc_id, stays repeated: `kept` is a property of the doc_id.
    """
    if "_gone" in documents.columns:
        raise ValueError("a column named _gone is already there")
    gone = materialise(near_duplicates(documents, p).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    size = gone.agg(F.coalesce(F.sum(F.length(F.col("_gone").cast("string")) + 24), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    return documents.join(gone, documents["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")
