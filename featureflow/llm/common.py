"""Helpers that the operators of this subpackage share: inputs, written tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on: its arrays stay within a core's cache.
CHUNK_BYTES = 512 * 1024
#: Most bytes of rows that an operator broadcasts; larger tables are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Code points of a text that are looked at as one value.
BLOCK = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own; a cluster has none that could be guessed."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="featureflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: plans that inline columns stay small."""
    return F.element_at(F.transform(F.array(value), f), 1)


def text_blocks(text: Column) -> Column:
    """A text in blocks of BLOCK code points, so that a place in it is found without walking there from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text in blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(some, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


_kept: dict[str, dict] = {}


def worker_tables(owner: str) -> dict:
    """What this Python worker keeps for an operator from task to task.

    Workers outlive a stage; when another operator's task comes, the tables of the one before go,
    and the memory they took goes back to the system.
    """
    if owner not in _kept:
        had = bool(_kept)
        _kept.clear()
        if had:
            gc.collect()
            give_back()
        _kept[owner] = {}
    return _kept[owner]


def give_back() -> None:
    """Return memory that is free but held by the allocators, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_worker(owner: str) -> Callable:
    """For functions over Arrow batches: other operators' tables go before the task, unused memory after it."""

    def of(run: Callable) -> Callable:
        @wraps(run)
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_tables(owner)
            yield from run(batches)
            give_back()

        return task

    return of


def drop(*tables: DataFrame) -> None:
    """Remove tables of `materialise` that nothing will read any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = 50_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each, and of `rows` rows at most; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n, a + rows)
        yield a, b
        a = b


def int_list(values: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    """A matrix as a list column, one list a row."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(values.ravel(), type_))
