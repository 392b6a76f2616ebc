"""Fits and encodes chains of encoders on the columns of one DataFrame.

All encoders at the same place of their chains are fitted together: their aggregates are one `agg` in
one pass, and those that several encoders of a column ask for are computed once. Encoding is one
projection on the rows, plus a join for each vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.operators.base import Encoder
from featureflow.operators.text import steps

Chain = tuple[str | int, list[Encoder]]


def named(df: DataFrame, column: str | int) -> str:
    """A column's name; a number counts columns from 0."""
    return df.columns[column] if isinstance(column, int) else column


def fit_chains(df: DataFrame, chains: list[Chain]) -> None:
    """Fit each encoder on what the ones before it in its chain make of the column."""
    chains = [(c, steps(e)) for c, e in chains]
    at: list[tuple[DataFrame, Column]] = [(df, F.col(named(df, c))) for c, _ in chains]
    for depth in range(max(len(e) for _, e in chains)):
        live = [i for i, (_, e) in enumerate(chains) if depth < len(e)]
        # Chains that joined a vocabulary have rows of their own; the others share one pass.
        groups: dict[int, list[int]] = {}
        for i in live:
            kind = at[i][0].select(at[i][1].alias("x")).schema["x"].dataType
            chains[i][1][depth].accepts(kind)
            groups.setdefault(id(at[i][0]), []).append(i)
        for members in groups.values():
            rows = at[members[0]][0]
            wanted: dict[tuple, Column] = {}
            names: dict[tuple[int, str], tuple] = {}
            for i in members:
                column, encoders = chains[i]
                for name, agg in encoders[depth].aggregates(at[i][1]).items():
                    # Of chains that differ before this place, aggregates differ.
                    key = (named(df, column), name, *(id(e) for e in encoders[:depth]))
                    wanted.setdefault(key, agg)
                    names[i, name] = key
            if wanted:
                keys = list(wanted)
                row = rows.agg(*[wanted[k].alias(f"a{j}") for j, k in enumerate(keys)]).first()
                for i in members:
                    found = {name: row[keys.index(k)] for (j, name), k in names.items() if j == i}
                    if found:
                        chains[i][1][depth].learn(found)
        for i in live:
            encoder = chains[i][1][depth]
            if encoder.numbers_values:
                encoder.learn_values(at[i][0].select(at[i][1].alias("value")))
            if depth + 1 < len(chains[i][1]):
                at[i] = encoder.encode(*at[i])


def encode_chains(df: DataFrame, chains: list[Chain]) -> tuple[DataFrame, list[Column]]:
    """df (with vocabularies joined) and each chain's encoded column."""
    out = []
    for column, encoders in chains:
        x = F.col(named(df, column))
        for e in steps(encoders):
            df, x = e.encode(df, x)
        out.append(x)
    return df, out
