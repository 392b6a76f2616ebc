"""CSV readers of the two kinds, rows by a rule, and what writes or watches results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a whole cell must look like to be a number; try_cast alone would take forms such as 1d.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def parse_number(cell: Column, default: float | None = -1.0) -> Column:
    """The trimmed cell as a double, `default` where it isn't one or is null."""
    cut = F.trim(cell)
    value = F.when(cut.rlike(NUMBER), cut.try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def read_numeric_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Every column as double; cells that aren't numbers are -1."""
    raw = spark.read.csv(path, header=header, inferSchema=False)
    return raw.select(*[parse_number(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def typed(raw: DataFrame) -> DataFrame:
    """String columns whose cells are all numbers or null, one at least, become double; the others are trimmed text. One pass over the rows decides."""
    flags = [F.every(F.col(f"`{c}`").isNull() | parse_number(F.col(f"`{c}`"), None).isNotNull() | F.lit(False)).alias(f"f{i}") for i, c in enumerate(raw.columns)]
    some = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(raw.columns)]
    row = raw.agg(*flags, *some).first()
    return raw.select(*[(parse_number(F.col(f"`{c}`"), None) if row[f"f{i}"] and row[f"n{i}"] else F.trim(F.col(f"`{c}`"))).alias(c) for i, c in enumerate(raw.columns)])


def read_mixed_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return typed(spark.read.csv(path, header=header, inferSchema=False))


def modulo_rows(spark: SparkSession, n: int, moduli: list[int]) -> DataFrame:
    """row_id from 0 to n - 1, and c0, c1, ... = row_id % modulus (0: row_id itself)."""
    return spark.range(n).select(F.col("id").alias("row_id"), *[(F.col("id") % m if m else F.col("id")).alias(f"c{i}") for i, m in enumerate(moduli)])


def random_texts(spark: SparkSession, n: int, words: list[str], least: int = 5, most: int = 10, seed: int = 0) -> DataFrame:
    """row_id and text of least to most words drawn by a seeded hash of the row id, the same on any cluster."""
    draw = lambda *key: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *key), F.lit(1 << 30))
    count = (draw(F.lit(-1)) % (most - least + 1) + least).cast("int")
    listed = F.lit(words)
    text = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(listed, (draw(i) % len(words) + 1).cast("int"))), " ")
    return spark.range(n).select(F.col("id").alias("row_id"), text.alias("text"))


def watch(df: DataFrame, name: str, *aggregates: Column) -> DataFrame:
    """df as it is; when it runs, the aggregates (the row count by default) go to query listeners under `name`."""
    return df.observe(name, *(aggregates or (F.count(F.lit(1)).alias("rows"),)))
