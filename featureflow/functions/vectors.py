"""Vectors from positions, in time that grows with the positions and the width, not with their product."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.storage import written

#: A vector by its width, the positions that aren't 0, in order, and their values.
SPARSE = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def histogram(items: Column) -> Column:
    """array<struct<k, n double>>: each distinct item of an array, in order, and how often it is there."""

    def counted(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("k"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("double").alias("n"))))

    return let(F.array_sort(items), counted)


def dense(entries: Column, width: int, binary: bool = False) -> Column:
    """array<double> of `width` from a histogram of positions."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def filled(e: Column) -> Column:
        part = lambda x, i: F.concat(zeros(x["k"] - F.when(i == 0, 0).otherwise(F.get(e, i - 1)["k"] + 1)), F.array(F.lit(1.0) if binary else x["n"]))
        return F.when(F.size(e) == 0, zeros(F.lit(width))).otherwise(F.concat(F.flatten(F.transform(e, part)), zeros(F.lit(width - 1) - F.element_at(e, -1)["k"])))

    return let(entries, filled)


def is_sparse(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.fieldNames() == SPARSE.fieldNames()


def looked_up(df: DataFrame, entries: Column, table: DataFrame, broadcast: bool) -> tuple[DataFrame, Column]:
    """df with `entries`, array<struct<k, n>>, looked up in table (value, to) by k: the column is the array<struct<to, k, n>> of those found, by `to`.

    Rows are written with a number, so that they find their entries again whatever tasks are lost;
    entries meet the table by join, so that it may have any size.
    """
    i = 0
    while {f"_row{i}", f"_pairs{i}"} & set(df.columns):
        i += 1
    row, pairs = f"_row{i}", f"_pairs{i}"
    rows = written(df.withColumn(row, F.monotonically_increasing_id()).withColumn(pairs, entries), "rows")
    apart = rows.select(row, F.inline(pairs).alias("k", "n"))
    found = apart.join(F.broadcast(table) if broadcast else table, F.col("k") == F.col("value"))
    again = found.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("to", "k", "n"))).alias(pairs))
    joined = rows.drop(pairs).join(again, row, "left")
    return joined, F.coalesce(F.col(pairs), F.array().cast(again.schema[pairs].dataType))
