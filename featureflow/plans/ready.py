"""Ready-made encoders."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.operators.categorical import OneHotEncoder, OrdinalEncoder
from featureflow.operators.scalers import KBinsDiscretizer, MinMaxScaler, StandardScaler
from featureflow.operators.stateless import Passthrough, PolynomialFeatures
from featureflow.operators.text import CountVectorizer, TfidfTransformer
from featureflow.plans.compose import MultiColumnEncoder, Pipeline, auto_encoder
from featureflow.streaming.incremental import IncrementalEncoder


def scale_all(df: DataFrame, round_mean: int | None = -2, round_var: int | None = -1) -> MultiColumnEncoder:
    """Standard scaling of every numeric column."""
    return MultiColumnEncoder([(f.name, StandardScaler(round_mean, round_var)) for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


def mixed_table(df: DataFrame, protected: list[str | int] = (8, 9), proxy: list[str | int] = (12,), target: str | int = 14) -> MultiColumnEncoder:
    """One-hot texts and plain numbers of a table, without protected and proxy columns and the target."""
    return auto_encoder(df, [*protected, *proxy, target])


def presentation(columns: list[str | int] = (0, 1, 2, 3, 4)) -> MultiColumnEncoder:
    a, b, c, d, e = columns
    return MultiColumnEncoder([(a, StandardScaler(-1, -1)), (b, MinMaxScaler()), (c, KBinsDiscretizer(4)), (d, OneHotEncoder()), (e, Passthrough())])


def polynomial(column: str | int = 0) -> MultiColumnEncoder:
    return MultiColumnEncoder([(column, PolynomialFeatures(1, 3))])


def standard_and_one_hot(columns: list[str | int] = (0, 1)) -> MultiColumnEncoder:
    return MultiColumnEncoder([(columns[0], StandardScaler()), (columns[1], OneHotEncoder())])


def nested(columns: list[str | int] = (0, 1)) -> MultiColumnEncoder:
    first = Pipeline([KBinsDiscretizer(5), OrdinalEncoder()])
    return MultiColumnEncoder([(columns[0], first), (columns[1], Pipeline([MinMaxScaler(), Pipeline([KBinsDiscretizer(3), OneHotEncoder()])]))])


def text_pipeline(rounding: int | None = None) -> Pipeline:
    return Pipeline([CountVectorizer(), TfidfTransformer(rounding)])


def text_features(column: str | int = 0) -> MultiColumnEncoder:
    return MultiColumnEncoder([(column, text_pipeline(-2))])


def three_numbers(columns: list[str | int] = (0, 1, 2)) -> MultiColumnEncoder:
    a, b, c = columns
    return MultiColumnEncoder([(a, StandardScaler()), (b, MinMaxScaler()), (c, KBinsDiscretizer(4))])


def row_by_row(spark: SparkSession, df: DataFrame, row_id: str, path: str, share: float = 0.9999, round_mean: int | None = -2, round_var: int | None = -1) -> Iterator[DataFrame]:
    """Standard scaling of all numeric columns but row_id (numbers 0, 1, ... of the rows), kept up to date: the first `share` of the rows in one epoch, then a row an epoch.

    Gives each epoch's changes (row_id, the columns, e0, e1, ..., diff), to be read before the next one is asked for.
    """
    columns = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != row_id]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [df.schema[row_id], *columns])
    inc = IncrementalEncoder(spark, [(f.name, StandardScaler(round_mean, round_var)) for f in columns], kinds, path)
    rows = df.select(row_id, *[f.name for f in columns]).withColumn("diff", F.lit(1))
    n = df.count()
    first = int(n * share)
    yield inc.process(0, rows.filter(F.col(row_id) < first))
    for epoch, i in enumerate(range(first, n), 1):
        yield inc.process(epoch, rows.filter(F.col(row_id) == i))
