"""Encoders without metadata: pure projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.text import bucket, tokens
from featureflow.functions.vectors import dense, histogram
from featureflow.operators.base import Encoder


class Passthrough(Encoder):
    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        return df, x


class FunctionEncoder(Encoder):
    """A function of Columns, which Catalyst sees; or with `returns`, a function of pandas Series, run in Arrow batches."""

    def __init__(self, f: Callable, returns: str | None = None):
        self.f = F.pandas_udf(f, returns) if returns else f

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        return df, self.f(x)


def _product(factors: list[Column]) -> Column:
    out = F.lit(1.0)
    for k, f in enumerate(factors):
        out = f if not k else out * f
    return out


def combinations(n: int, least: int, most: int) -> list[tuple[int, ...]]:
    """Index combinations with repetition of each degree; within a degree those without the first index come first."""

    def of(degree: int, first: int) -> list[tuple[int, ...]]:
        if not degree:
            return [()]
        if first >= n:
            return []
        return of(degree, first + 1) + [(first, *rest) for rest in of(degree - 1, first)]

    return [c for degree in range(least, most + 1) for c in of(degree, 0)]


class PolynomialFeatures(Encoder):
    """Powers least to most of a number; of a vector with `features` components, all their products of these degrees."""

    def __init__(self, least: int, most: int, features: int | None = None):
        if least < 0 or most < least:
            raise ValueError("0 <= least <= most is needed")
        self.least, self.most, self.features = least, most, features

    def accepts(self, kind: T.DataType) -> None:
        if isinstance(kind, T.ArrayType) != bool(self.features) or not isinstance(kind, (T.NumericType, T.ArrayType)):
            raise TypeError(f"PolynomialFeatures can't encode {kind.simpleString()} here")

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        if self.features:
            part = [F.element_at(x, i + 1).cast("double") for i in range(self.features)]
            return df, F.array(*[_product([part[i] for i in c]) for c in combinations(self.features, self.least, self.most)])
        x = x.cast("double")
        return df, F.array(*[_product([x] * d) for d in range(self.least, self.most + 1)])


class HashVectorizer(Encoder):
    """Counts (or 0 and 1) of a text's tokens in n_features buckets by hash; null text gives zeros."""

    def __init__(self, n_features: int, binary: bool = False, how: str = "xxhash64"):
        if n_features < 1:
            raise ValueError("n_features must be 1 at least")
        self.n, self.binary, self.how = n_features, binary, how

    def accepts(self, kind: T.DataType) -> None:
        if not isinstance(kind, T.StringType):
            raise TypeError("HashVectorizer needs text")

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        hashed = F.transform(tokens(F.coalesce(x, F.lit(""))), lambda t: bucket(t, self.n, self.how))
        return df, dense(histogram(hashed), self.n, self.binary)
