"""Scalers and bins: encoders whose metadata are a few numbers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.numeric import round_to, scale
from featureflow.operators.base import Encoder, NotFittedError, numeric


class StandardScaler(Encoder):
    """(x - mean) / population variance. Rounding to multiples of 10^n keeps metadata, and so output, still under small updates."""

    def __init__(self, round_mean: int | None = None, round_var: int | None = None):
        self.round_mean, self.round_var = round_mean, round_var
        self.meta: tuple[float, float] | None = None

    def accepts(self, kind: T.DataType) -> None:
        numeric(kind, "StandardScaler")

    def aggregates(self, x: Column) -> dict[str, Column]:
        x = x.cast("double")
        return {"mean": F.avg(x), "var": F.var_pop(x)}

    def learn(self, found: dict[str, Any]) -> None:
        nan = float("nan")
        mean, var = (nan if found[k] is None else found[k] for k in ("mean", "var"))
        self.meta = round_to(mean, self.round_mean), round_to(var, self.round_var)

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        if self.meta is None:
            raise NotFittedError("StandardScaler")
        return df, scale(x, *self.meta)


class MinMaxScaler(Encoder):
    """(x - min) / (max - min); NaN if all values are equal."""

    def __init__(self) -> None:
        self.meta: tuple[float, float] | None = None

    def accepts(self, kind: T.DataType) -> None:
        numeric(kind, type(self).__name__)

    def aggregates(self, x: Column) -> dict[str, Column]:
        x = x.cast("double")
        return {"min": F.min(x), "max": F.max(x)}

    def learn(self, found: dict[str, Any]) -> None:
        low, high = found["min"], found["max"]
        self.meta = (float("nan"),) * 2 if low is None else (low, high - low)

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        if self.meta is None:
            raise NotFittedError(type(self).__name__)
        return df, scale(x, *self.meta)


class KBinsDiscretizer(MinMaxScaler):
    """Bins of equal width: the scaled value times k, cut towards zero, at most k - 1; below the least value bins are negative. NaN is bin 0."""

    def __init__(self, k: int):
        if k < 1:
            raise ValueError("k must be 1 at least")
        super().__init__()
        self.k = k

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        df, scaled = super().encode(df, x)
        part = scaled * F.lit(float(self.k))
        top = F.lit(float(self.k - 1))
        cut = F.when(part >= top, top).when(part < 0, F.ceil(F.greatest(part, F.lit(-9.2e18))).cast("double")).otherwise(F.floor(part).cast("double"))
        return df, F.when(F.isnan(part), F.lit(0.0)).otherwise(cut + F.lit(0.0))
