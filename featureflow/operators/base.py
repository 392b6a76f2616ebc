"""What an encoder is.

An encoder works on one column. Fitting asks it for aggregates, which a plan computes for all columns
in one pass, and for a vocabulary if it has one; encoding gives back an expression on the same rows.
No encoder slices a column off, so nothing has to be joined again by row id.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotFittedError(RuntimeError):
    pass


class Encoder(ABC):
    """fit() on a column of a DataFrame, then transform() on that or another one."""

    #: Set by encoders that number values: see operators.categorical.
    numbers_values = False

    def accepts(self, kind: T.DataType) -> None:
        """Raise TypeError for a column type that can't be encoded."""

    def aggregates(self, x: Column) -> dict[str, Column]:
        """What fitting needs, by name; equal names mean equal aggregates of the same column."""
        return {}

    def learn(self, found: dict[str, Any]) -> None:
        """Take the aggregates' values."""

    @abstractmethod
    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        """df (perhaps with columns joined) and the encoded column."""

    def fit(self, df: DataFrame, column: str) -> Encoder:
        from featureflow.plans.planner import fit_chains

        fit_chains(df, [(column, [self])])
        return self

    def transform(self, df: DataFrame, column: str, to: str = "encoded") -> DataFrame:
        joined, out = self.encode(df, F.col(column))
        return joined.withColumn(to, out).select(*df.columns, to)

    def fit_transform(self, df: DataFrame, column: str, to: str = "encoded") -> DataFrame:
        return self.fit(df, column).transform(df, column, to)


def numeric(kind: T.DataType, what: str) -> None:
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{what} needs a numeric column, not {kind.simpleString()}")
