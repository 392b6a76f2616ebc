"""Seeded global shuffle into shards, as a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash; pass 2
shuffles each bucket with Fisher-Yates and writes it. The buckets one after another are a uniformly
random order of all records, which is cut into shards whose record counts differ by one at most.

Before that, the sum of sizes says how many buckets there are, and a count of each gives the place of
its first record. Bucket and place depend on the records and the seed alone, not on how the input is
partitioned, so a lost task is repeated with the same result.

Cases: null text counts as no bytes; null doc_ids and repeated rows are records as any others. The
hash takes all columns, so copies under different ids are spread; only rows that agree in all columns
share a bucket, and any of them may have any of their places. A text above a bucket's size makes its
bucket as large. Columns are types that can be hashed, which maps can't. An empty table gives none. Other
columns are carried along; names `shard`, `slot`, `_h` and `_b` are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.llm.common import in_worker

#: Bytes of text in a bucket, on average half of it.
BUCKET_BYTES = 24 << 20


def _hash(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])


def shuffled(df: DataFrame, n_shards: int, seed: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df (doc_id, text, ...) with `shard` int and `slot` long (gapless from 0 in each shard) added."""
    if clash := {"shard", "slot", "_h", "_b"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are already there")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    n_bytes = df.agg(F.sum(size)).first()[0] or 0
    n_buckets = max(1, -(-2 * n_bytes // bucket_bytes))
    # Equal ranges of the hash, without a search: the upper 32 bits times the count, shifted back.
    bucket = F.shiftright(F.shiftrightunsigned("_h", 32) * F.lit(n_buckets), 32).cast("int")
    dealt = df.withColumn("_h", _hash(df, seed)).withColumn("_b", bucket)
    rows = np.zeros(n_buckets, np.int64)
    for b, n in dealt.groupBy("_b").count().collect():  # a row a bucket, so 1 in many thousand bytes of input
        rows[b] = n
    total, first = int(rows.sum()), np.concatenate([[0], np.cumsum(rows)])
    base, more = divmod(total, n_shards)
    shard_start = np.arange(n_shards + 1) * base + np.minimum(np.arange(n_shards + 1), more)
    fields = df.schema.fields
    place = df.columns.index("doc_id")

    @in_worker("sharding")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        # The order of arrival depends on the network: sort by what the records are, then shuffle.
        key = table.column("_h")
        order = pc.sort_indices(pa.table({"h": key, "i": table.column(place)}), sort_keys=[("h", "ascending"), ("i", "ascending")]).to_numpy()
        order = order[fisher_yates(len(order), seed, at)]
        ranks = first[at] + np.arange(len(order))
        shard = np.searchsorted(shard_start, ranks, "right") - 1
        table = table.drop_columns(["_h", "_b"])
        for a in range(0, len(order), 2000):
            part = table.take(pa.array(order[a : a + 2000])).combine_chunks()
            s, r = shard[a : a + 2000], ranks[a : a + 2000]
            part = part.append_column("shard", pa.array(s, pa.int32())).append_column("slot", pa.array(r - shard_start[s], pa.int64()))
            yield from part.to_batches()

    schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return dealt.repartitionById(n_buckets, F.col("_b")).mapInArrow(run, schema)


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of n things: each place from the last swaps with one at or before it."""
    draw = np.random.default_rng([seed & 0xFFFFFFFF, bucket])
    other = (draw.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = other[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shards under path/shard=N; rows are in the order of their slots within each file."""
    shuffled(df, n_shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
