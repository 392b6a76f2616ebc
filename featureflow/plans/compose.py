"""Encoders put together: one after another on a column, or side by side into a vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.operators.base import Encoder, NotFittedError
from featureflow.operators.categorical import OneHotEncoder
from featureflow.operators.stateless import Passthrough
from featureflow.operators.text import steps
from featureflow.plans.planner import encode_chains, fit_chains, named


def flat(encoder: Encoder) -> list[Encoder]:
    """The encoders of a pipeline, pipelines within it taken apart."""
    return [e for part in encoder.encoders for e in flat(part)] if isinstance(encoder, Pipeline) else [encoder]


class Pipeline(Encoder):
    """Each encoder works on what the one before it gives. A pipeline is an encoder, so it nests."""

    def __init__(self, encoders: list[Encoder]):
        if not encoders:
            raise ValueError("a pipeline needs an encoder")
        self.encoders = encoders

    def fit(self, df: DataFrame, column: str) -> Pipeline:
        fit_chains(df, [(column, flat(self))])
        return self

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        for e in steps(flat(self)):
            df, x = e.encode(df, x)
        return df, x


class MultiColumnEncoder:
    """Encoders side by side: (column name or number, encoder) entries, in order, into one vector a row.

    A single entry gives its value as it is. Rows keep their multiplicity and, where asked, columns
    such as a row id; without, the result is a bag of vectors.
    """

    def __init__(self, config: list[tuple[str | int, Encoder]]):
        if not config:
            raise ValueError("an encoder for one column at least is needed")
        self.chains = [(column, flat(e)) for column, e in config]
        self.fitted = False

    def fit(self, df: DataFrame) -> MultiColumnEncoder:
        fit_chains(df, self.chains)
        self.fitted = True
        return self

    def columns(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """A column e0, e1, ... for each entry."""
        if not self.fitted:
            raise NotFittedError("MultiColumnEncoder")
        rows, out = encode_chains(df, self.chains)
        return rows.select(*(keep or []), *[c.alias(f"e{i}") for i, c in enumerate(out)])

    def transform(self, df: DataFrame, keep: list[str] | None = None, to: str = "vector") -> DataFrame:
        parts = self.columns(df, keep)
        names = [f"e{i}" for i in range(len(self.chains))]
        if len(names) == 1:
            return parts.withColumnRenamed("e0", to)
        arrays = []
        for name in names:
            kind = parts.schema[name].dataType
            if isinstance(kind, T.ArrayType):
                arrays.append(F.col(name).cast("array<double>"))
            elif isinstance(kind, T.NumericType):
                arrays.append(F.array(F.col(name).cast("double")))
            else:
                raise TypeError(f"{kind.simpleString()} can't be part of a vector")
        return parts.select(*(keep or []), F.concat(*arrays).alias(to))

    def fit_transform(self, df: DataFrame, keep: list[str] | None = None, to: str = "vector") -> DataFrame:
        return self.fit(df).transform(df, keep, to)


def auto_encoder(df: DataFrame, exclude: list[str | int]) -> MultiColumnEncoder:
    """One-hot for the text columns, then the numeric ones as they are, without those excluded."""
    out = {named(df, c) for c in exclude}
    rest = [f for f in df.schema.fields if f.name not in out]
    text = [(f.name, OneHotEncoder()) for f in rest if isinstance(f.dataType, T.StringType)]
    numbers = [(f.name, Passthrough()) for f in rest if isinstance(f.dataType, T.NumericType)]
    return MultiColumnEncoder([*text, *numbers])
