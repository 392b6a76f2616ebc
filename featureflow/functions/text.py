"""Tokens of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Parts between Unicode white space, none of them empty; null stays null."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def bucket(token: Column, n_features: int, how: str = "xxhash64") -> Column:
    """A stable bucket from 0 to n_features - 1: xxhash64, or the first 32 bits of md5, which SQL engines share."""
    if n_features < 1:
        raise ValueError("n_features must be 1 at least")
    if how == "xxhash64":
        return F.pmod(F.xxhash64(token), F.lit(n_features)).cast("int")
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % n_features).cast("int")
