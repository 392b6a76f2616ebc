"""Numeric helpers as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinities and NaN instead of errors or nulls where b is 0."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, a / b).when((b.isNull()) | (a.isNull()), F.lit(None).cast("double")).when(F.isnan(a) | F.isnan(b) | (a == 0), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)


def round_to(x: float, n: int | None) -> float:
    """x rounded to a multiple of 10^n, halves away from zero; None leaves it as it is."""
    if n is None or x != x or x in (float("inf"), float("-inf")):
        return x
    factor = 10.0**n
    scaled = x / factor
    whole = float(int(scaled))
    part = scaled - whole
    if abs(part) >= 0.5:
        whole += 1.0 if scaled > 0 else -1.0
    return whole * factor


def scale(x: Column, shift: float, by: float) -> Column:
    """(x - shift) / by with IEEE division; the metadata are literals of the plan."""
    x = x.cast("double")
    if by != 0 and by == by:
        return (x - F.lit(shift)) / F.lit(by)
    return ieee_div(x - F.lit(shift), F.lit(by))
