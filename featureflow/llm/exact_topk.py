"""Exact top-k by inner product over a vector-approximation file.

The file holds, for blocks of vectors, one byte a component that names a cell of even width between the
block's least and greatest value of that component. It is written once, and scanned by blocks of
queries: one matrix product over the cells' centres, and half a cell in each component's worse and
better direction, bound every score from above and below. A vector whose upper bound is under the kth
greatest lower bound of its query, first of its block and then of all blocks, is out.

Exact vectors are then read in the order of their upper bounds: the best k of each query first, which
give a kth exact score, and after them only those whose upper bound reaches it (or equals it, for ties).
So the exact vectors don't meet blocks of queries; only those that may win meet their query.

Of equal vectors, only the k + 1 with the smallest ids can be among a query's best k (the query may be
one of them), so the others are left out before; a vector that a third of all rows hold is k + 1 rows.

Cases: vectors that are null or hold null or non-finite components take no part; nor does a null
vec_id. Vectors of different lengths don't meet. A vector isn't a candidate of queries with its
vec_id; repeated rows are candidates each, and one query; of different vectors with one vec_id the
least, component by component, is the query. Ties go to the smaller vec_id. Fewer than k candidates
give as many ranks. Empty vectors score 0. Scores beyond 64 bits raise an error. An empty table gives
none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.llm.common import drop, in_worker, materialise

#: Vectors, and queries, in a block.
VECTORS, QUERIES = 4096, 512
CELLS = 256
#: Pairs of blocks that one task compares, and most tasks of that.
PAIRS, MOST_TASKS = 2, 20_000


def grid(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """embeddings (vec_id, embedding) -> vec_id, v array<long>: floor(scale * x) of each component; unfit rows go."""
    x = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    fit = x.filter("vec_id IS NOT NULL AND x IS NOT NULL").filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return fit.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's vectors -> the cells' lower ends, their widths (by component), and each component's cell."""
    low, high = vectors.min(0).astype(float), vectors.max(0).astype(float)
    width = (high - low) / CELLS
    return low, width, np.clip((vectors - low) / np.where(width > 0, width, 1.0), 0, CELLS - 1).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of queries (rows) with cells' centres (columns), and how much each query's exact scores may differ."""
    centres = (low + width / 2 + cells * width).astype(np.float32)
    q = queries.astype(np.float32)
    # Single precision, and the rounding of cells, err by less than the second term.
    slack = np.abs(queries).astype(float) @ (width / 2 * 1.001) + 1e-5 * (np.abs(q).astype(float) @ np.abs(centres).max(0).astype(float)) + 1e-3
    middle = (q @ centres.T).astype(float)
    return np.where(np.isfinite(middle), middle, 0.0), np.where(np.isfinite(middle).all(1) & np.isfinite(slack), slack, np.inf)


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows packed by length and seeded hash, about `size` each: dim, block, rows."""
    counts = {r.dim: -(-r.n // size) for r in df.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each length of vector
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.size("v")) if counts else F.lit(1)
    block = F.pmod(F.xxhash64(F.lit(5), "vec_id"), n_blocks).cast("int")
    return df.groupBy(F.size("v").alias("dim"), block.alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))


def _matrix(rows: pa.StructScalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(rows.values.field("vec_id")), np.asarray(rows.values.field("v").flatten()).reshape(len(rows.values), dim)


def approximation(blocks: DataFrame) -> DataFrame:
    """Blocks of exact vectors -> the file's rows: dim, block, ids, low, width, cells."""
    names = ["dim", "block", "ids", "low", "width", "cells"]

    @in_worker("exact_topk")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, x = _matrix(batch.column(2)[i], batch.column(0)[i].as_py())
                low, width, cells = approximate(x)
                arrays = [pa.array([v.tolist()], pa.list_(k)) for v, k in ((ids, pa.int64()), (low, pa.float64()), (width, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:2]), *arrays, pa.array([cells.tobytes()], pa.binary())], names)

    return blocks.select("dim", "block", "rows").mapInArrow(run, "dim int, block int, ids array<long>, low array<double>, width array<double>, cells binary")


def scan(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs (dim, block, ids, low, width, cells, q) -> query_id, dim, block, pos, low, high: vectors whose upper bound reaches the kth lower bound of their block."""
    names = ["query_id", "dim", "block", "pos", "low", "high"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    @in_worker("exact_topk")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                dim, block, ids, low, width, cells, q = (c[i] for c in batch.columns)
                ids = np.asarray(ids.values)
                q_ids, queries = _matrix(q, dim.as_py())
                shape = (len(ids), dim.as_py())
                middle, slack = bounds(queries, np.asarray(low.values), np.asarray(width.values), np.frombuffer(cells.as_buffer(), np.uint8).reshape(shape))
                out = []
                for j, qid in enumerate(q_ids.tolist()):
                    m = np.where(ids == qid, -np.inf, middle[j])
                    others = int((ids != qid).sum())
                    # The kth lower bound less the slack is reached by all whose middle is two slacks below it.
                    least = np.partition(m, -k)[-k] - 2 * slack[j] if others > k else -np.inf
                    at = np.flatnonzero((m >= least) & (ids != qid))
                    out.append((np.full(len(at), qid), at, m[at] - slack[j], m[at] + slack[j]))
                if out:
                    q_, at, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((q_, np.full(len(at), dim.as_py()), np.full(len(at), block.as_py()), at, a, b), kinds, strict=True)], names)

    return pairs.mapInArrow(run, "query_id long, dim int, block int, pos int, low double, high double")


def _ranked(by: Column, *then: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(by, *then))


def _exact(candidates: DataFrame, blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates (query_id, dim, block, pos) with vec_id and their exact score."""
    vectors = blocks.select("dim", "block", F.posexplode("rows").alias("pos", "r")).select("dim", "block", "pos", "r.vec_id", "r.v")
    both = candidates.join(vectors, ["dim", "block", "pos"]).join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: F.try_multiply(a, b)), F.lit(0).cast("long"), lambda acc, x: F.try_add(acc, x))
    return both.select("query_id", "vec_id", F.coalesce(product, F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")).alias("score"))


def top_k(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """vectors (vec_id, v array<long>) -> query_id, rank (from 1), vec_id, score: for each vec_id divisible by `every`, its best k."""
    rows = materialise(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("n")), "rows")
    queries = materialise(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    of_equal = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    # Of equal rows, no more than k can be among the best k.
    some = rows.withColumn("r", of_equal).filter(F.col("r") <= k + 1)
    some = materialise(some.withColumn("n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))).select("vec_id", "v"), "some")
    blocks = materialise(_blocks(some, VECTORS), "vectors")
    file = materialise(approximation(blocks), "approximation")

    q = materialise(_blocks(queries, QUERIES).select("dim", F.col("block").alias("q_block"), F.col("rows").alias("q")), "query-blocks")
    meets = q.select("dim", "q_block").join(file.select("dim", "block"), "dim")
    tasks = max(1, min(MOST_TASKS, meets.count() // PAIRS))
    pairs = file.join(meets, ["dim", "block"]).join(q, ["dim", "q_block"]).repartition(tasks, "dim", "block", "q_block")
    near = scan(pairs.select("dim", "block", "ids", "low", "width", "cells", "q"), k)
    # The kth greatest lower bound of all blocks.
    known = materialise(near, "candidates")
    kth = known.withColumn("r", _ranked(F.desc("low"), "dim", "block", "pos")).filter(F.col("r") == k).select("query_id", F.col("low").alias("least"))
    left = known.join(kth, "query_id", "left").filter(F.col("least").isNull() | (F.col("high") >= F.col("least"))).drop("least", "low")
    # Exact vectors in the order of their upper bounds: k of each query, then those that still may win.
    ordered = materialise(left.withColumn("r", _ranked(F.desc("high"), "dim", "block", "pos")), "ordered")
    first = materialise(_exact(ordered.filter(F.col("r") <= k), blocks, queries), "first")
    certain = first.groupBy("query_id").agg(F.min("score").cast("double").alias("least"))
    rest = ordered.filter(F.col("r") > k).join(certain, "query_id").filter(F.col("high") >= F.col("least") * (1 - F.signum("least") * 1e-12))
    found = materialise(first.unionByName(_exact(rest, blocks, queries)), "scores")
    drop(rows, queries, some, blocks, file, q, known, ordered, first)
    return found.withColumn("rank", _ranked(F.desc("score"), "vec_id")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
