"""Encoders that number the distinct values of a column.

A vocabulary is a table (value, pos); positions follow the values' order. It is joined to the rows by
value: by broadcast if its bytes are few enough, and by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.capacity import capacity
from featureflow.functions.storage import BROADCAST_BYTES, drop, written
from featureflow.operators.base import Encoder, NotFittedError

#: Values up to which a vocabulary is numbered in one task; bytes of a broadcast row besides its value.
ONE_TASK, ROW_BYTES = 100_000, 40


def numbered(distinct: DataFrame, n: int, one_task: int = ONE_TASK) -> DataFrame:
    """distinct (value, ...), n rows without null -> (value, ..., pos): places in the values' order.

    Many values are ranked by range partitions: each partition's rows are numbered on their own, and
    start where the partitions before it end.
    """
    if n <= one_task:
        return written(distinct.select("*", (F.row_number().over(Window.orderBy("value")) - 1).cast("int").alias("pos")), "vocabulary")
    parts = written(distinct.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "parts")
    starts, at = {}, 0
    for r in parts.groupBy("part").count().orderBy("part").collect():  # one row a partition
        starts[r.part] = at
        at += r["count"]
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("part")]
    place = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1 + start
    out = written(parts.select(*distinct.columns, place.cast("int").alias("pos")), "vocabulary")
    drop(parts)
    return out


def vocabulary(values: DataFrame) -> tuple[DataFrame, int]:
    """values (value) -> (value, pos) of its distinct non-null values, and how many they are."""
    distinct = written(values.filter("value IS NOT NULL").distinct(), "values")
    n = distinct.count()
    out = numbered(distinct, n)
    drop(distinct)
    return out, n


def small(table: DataFrame) -> bool:
    """Whether the bytes of a (value, ...) table allow its broadcast."""
    size = F.octet_length(F.col("value")) if isinstance(table.schema["value"].dataType, T.StringType) else F.lit(8)
    return table.agg(F.coalesce(F.sum(size.cast("long") + ROW_BYTES), F.lit(0))).first()[0] <= BROADCAST_BYTES


class Numbering(Encoder):
    """Shared by the encoders of this module."""

    numbers_values = True

    def __init__(self) -> None:
        self.values: DataFrame | None = None
        self.n, self.broadcast = 0, True

    def accepts(self, kind: T.DataType) -> None:
        if not isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise TypeError(f"{type(self).__name__} can't number values of type {kind.simpleString()}")

    def learn_values(self, values: DataFrame) -> None:
        self.take(*vocabulary(values))

    def take(self, values: DataFrame, n: int) -> None:
        """A vocabulary (value, pos) of n values."""
        self.values, self.n, self.broadcast = values, n, small(values)

    def _position(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        if self.values is None:
            raise NotFittedError(type(self).__name__)
        k = 0
        while {f"_key{k}", f"_value{k}", f"_pos{k}"} & set(df.columns):  # a user's column, or another encoder's
            k += 1
        table = self.values.select(F.col("value").alias(f"_value{k}"), F.col("pos").alias(f"_pos{k}"))
        joined = df.withColumn(f"_key{k}", x)
        joined = joined.join(F.broadcast(table) if self.broadcast else table, F.col(f"_key{k}") == F.col(f"_value{k}"), "left").drop(f"_key{k}", f"_value{k}")
        return joined, F.col(f"_pos{k}")


class OrdinalEncoder(Numbering):
    """A value's position as a double; -1 for values that weren't there at fitting, and for null."""

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        df, pos = self._position(df, x)
        return df, F.coalesce(pos.cast("double"), F.lit(-1.0))


class OneHotEncoder(Numbering):
    """A vector as wide as the vocabulary's capacity with a 1 at the value's position; zeros for unseen values and null."""

    #: Set where the width is kept by someone else, who may have shrunk it.
    kept_width: int | None = None

    @property
    def width(self) -> int:
        return self.kept_width or capacity(self.n)

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        df, pos = self._position(df, x)
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        hot = F.concat(zeros(pos), F.array(F.lit(1.0)), zeros(F.lit(self.width - 1) - pos))
        return df, F.when(pos.isNull(), zeros(F.lit(self.width))).otherwise(hot)
