"""Token counts and TF-IDF: dense vectors for small vocabularies, sparse ones and (row, position, value) tables for any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.capacity import capacity
from featureflow.functions.counting import PACKED, VECTOR, filled, frequencies, packed
from featureflow.functions.storage import drop, written
from featureflow.functions.text import tokens
from featureflow.functions.vectors import SPARSE, dense, histogram, is_sparse, looked_up
from featureflow.operators.base import Encoder, NotFittedError
from featureflow.operators.categorical import numbered, small

#: Vocabulary up to which vectors are dense; beyond it they would mostly be zeros, and are sparse.
DENSE = 1000
#: Most tokens that every worker holds, those of most rows first, and the bytes that one of them may have; the others are joined.
HEAD, HEAD_BYTES = 500_000, 64


class CountVectorizer(Encoder):
    """How often (or whether) each token of the vocabulary is in a text; as wide as the vocabulary's capacity. Unknown tokens are ignored.

    Vectors are array<double> for vocabularies of up to DENSE tokens, and struct<size, indices, values>
    beyond. Null text gives zeros.
    """

    numbers_values = True
    #: Set where the width is kept by someone else, who may have shrunk it.
    kept_width: int | None = None

    def __init__(self, binary: bool = False):
        self.binary = binary
        self.values: DataFrame | None = None  # (value, pos), and have where it was fitted: how many rows have the token
        self.n, self.broadcast = 0, True

    def accepts(self, kind: T.DataType) -> None:
        if not isinstance(kind, T.StringType):
            raise TypeError("CountVectorizer needs text")

    def learn_values(self, values: DataFrame) -> None:
        parts = values.select("value").mapInArrow(frequencies, "value string, have long")
        found = written(parts.groupBy("value").agg(F.sum("have").alias("have")), "values")
        n = found.count()
        self.take(numbered(found, n), n)
        drop(found)

    def take(self, values: DataFrame, n: int) -> None:
        self.values, self.n, self.broadcast = values, n, small(values)

    @property
    def width(self) -> int:
        return self.kept_width or capacity(self.n)

    def _table(self) -> DataFrame:
        if self.values is None:
            raise NotFittedError("CountVectorizer")
        return self.values

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        table = self._table()
        if self.n <= DENSE:
            words = tokens(F.coalesce(x, F.lit("")))
            pairs = [F.lit(v) for r in table.collect() for v in (r.value, r.pos)]  # DENSE rows at most
            known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")
            at = F.filter(F.transform(words, lambda t: known[t]), lambda p: p.isNotNull())
            return df, dense(histogram(at), self.width, self.binary)
        return self.sparse(df, x, F.lit(1.0))

    def sparse(self, df: DataFrame, x: Column, weight: Column) -> tuple[DataFrame, Column]:
        """Sparse vectors of counts times `weight`, a column of the vocabulary's table.

        Tokens of many rows are looked up where the texts are taken apart. The others are few; if there
        are any, rows are written with a number, so that they find them again whatever tasks are lost.
        """
        table = self._table()
        n = table.count()
        table = table.select("value", "pos", weight.alias("w"), self._in_head(table, n).alias("in_head"))
        head = table.filter("in_head").select("value", "pos", "w").toArrow().sort_by("pos")  # HEAD rows at most
        value, pos, w = (head.column(c).combine_chunks() for c in ("value", "pos", "w"))
        take_apart = F.arrow_udf(packed(value), PACKED)
        put_together = F.arrow_udf(filled(pos.to_numpy(), w.to_numpy(), self.binary), VECTOR)
        parts, rest_of, to = (_free(df, c) for c in ("_parts", "_rest", "_vector"))
        if head.num_rows < n:
            row = _free(df, "_row")
            rows = written(df.withColumn(row, F.monotonically_increasing_id()).withColumn(parts, take_apart(x.cast("string"))), "rows")
            rest = table.filter("NOT in_head").select("value", F.col("pos").alias("to"), "w")
            apart = rows.select(row, F.inline(F.col(parts)["rest"]).alias("k", "n"))
            found = apart.join(F.broadcast(rest) if self.broadcast else rest, F.col("k") == F.col("value"))
            again = found.groupBy(row).agg(F.collect_list(F.struct("to", "n", "w")).alias(rest_of))
            df = rows.withColumn(parts, F.struct(F.col(parts)["at"].alias("at"), F.col(parts)["n"].alias("n"))).join(again, row, "left")
            rest = F.col(rest_of)
        else:
            df = df.withColumn(parts, take_apart(x.cast("string")))
            rest = F.lit(None).cast("array<struct<to: int, n: int, w: double>>")
        df = df.withColumn(to, put_together(F.col(parts)["at"], F.col(parts)["n"], rest))
        return df, F.struct(F.lit(self.width).alias("size"), F.col(to)["indices"].alias("indices"), F.col(to)["values"].alias("values")).cast(SPARSE)

    def _in_head(self, table: DataFrame, n: int) -> Column:
        """Whether a token of the table of n rows is one that every worker holds."""
        short = F.octet_length("value") <= HEAD_BYTES
        if n <= HEAD:
            return short
        if "have" not in table.columns:
            return F.lit(False)
        least, left = None, HEAD
        for r in table.groupBy("have").count().orderBy(F.desc("have")).collect():  # as many as there are different numbers
            left -= r["count"]
            if left < 0:
                break
            least = r.have
        return F.lit(False) if least is None else short & (F.col("have") >= least)

    def table(self, df: DataFrame, row_id: str, column: str) -> DataFrame:
        """(row_id, pos, value) of the values that aren't 0, for vocabularies of any size."""
        found = token_counts(df, row_id, column)
        words = self._table()
        words = F.broadcast(words) if self.broadcast else words
        value = F.lit(1.0) if self.binary else F.col("n").cast("double")
        return found.join(words, found["token"] == words["value"]).select(row_id, "pos", value.alias("value"))


def token_counts(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, token, n): counts of each row's tokens; rows with equal ids are counted together."""
    return df.select(row_id, F.explode(tokens(F.col(column))).alias("token")).groupBy(row_id, "token").agg(F.count("*").alias("n"))


def weight(n: float, count: Column) -> Column:
    """ln(n / count), 0 where the count is 0."""
    return F.when(count > 0, F.log(F.lit(float(n)) / count)).otherwise(F.lit(0.0))


def rounded(count: Column, digits: int | None) -> Column:
    """A count as a multiple of 10^digits, cut to an integer."""
    if digits is None:
        return count
    factor = 10.0**digits
    return (F.round(count / F.lit(factor)) * F.lit(factor)).cast("long")


def tfidf_table(df: DataFrame, row_id: str, column: str, df_mode: str = "absent", rounding: int | None = None) -> DataFrame:
    """(row_id, token, value) of the rows' tokens: count times ln(N / a), a being the rows that lack the token.

    df_mode "present" divides by the rows that have it instead, as textbooks do. Texts are taken apart
    once: their counts are written, and give the document frequencies too. N counts all rows, those
    without text too.
    """
    if df_mode not in ("absent", "present"):
        raise ValueError("df_mode is absent or present")
    counts = written(token_counts(df, row_id, column), "counts")
    n = df.count()
    have = written(counts.groupBy(F.col("token").alias("value")).agg(F.count("*").alias("have")), "frequencies")
    base = F.lit(n) - F.col("have") if df_mode == "absent" else F.col("have")
    weights = have.select("value", weight(n, rounded(base, rounding)).alias("w"))
    weights = F.broadcast(weights) if small(have) else weights
    return counts.join(weights, counts["token"] == weights["value"]).select(row_id, "token", (F.col("n") * F.col("w")).alias("value"))


class TfidfTransformer(Encoder):
    """On count vectors, dense or sparse: each count times ln(N / rows where it is 0); 0 where the count is, or where no row lacks the token."""

    numbers_values = True

    def __init__(self, rounding: int | None = None):
        self.rounding = rounding
        self.weights: DataFrame | None = None  # (value, to, w): position twice, and its weight
        self.broadcast, self.n = True, 0
        #: The vocabulary whose tokens were counted, where that is known.
        self.of: DataFrame | None = None

    def accepts(self, kind: T.DataType) -> None:
        if not isinstance(kind, T.ArrayType) and not is_sparse(kind):
            raise TypeError("TfidfTransformer needs vectors")

    def learn_values(self, values: DataFrame) -> None:
        self.take(written(present(values.withColumn("diff", F.lit(1))), "present"), values.filter("value IS NOT NULL").count())

    def take(self, have: DataFrame, n: int) -> None:
        """have (pos, have): how many of n rows have something at a position; positions that are missing have nothing."""
        self.n, self.of = n, None
        table = have.select(F.col("pos").alias("value"), F.col("pos").alias("to"), self.weight().alias("w"))
        self.weights, self.broadcast = table, small(table)

    def weight(self) -> Column:
        """The weight of what `have` rows have."""
        return weight(self.n, rounded(F.lit(self.n) - F.col("have"), self.rounding))

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        if self.weights is None:
            raise NotFittedError("TfidfTransformer")
        kind = df.select(x.alias("x")).schema["x"].dataType
        if isinstance(kind, T.ArrayType):
            found = {r.to: r.w for r in self.weights.collect()}  # as many rows as the vector is wide
            weights = F.lit([found.get(i, 0.0) for i in range(max(found) + 1)]) if found else F.array().cast("array<double>")
            return df, F.transform(x, lambda v, i: F.when(v == 0, F.lit(0.0)).otherwise(v * F.coalesce(F.get(weights, i), F.lit(0.0))))
        pairs = F.zip_with(x["indices"], x["values"], lambda i, v: F.struct(i.alias("k"), F.struct(v.alias("v"), x["size"].alias("size")).alias("n")))
        size = x["size"]
        df = df.withColumn(name := _free(df, "_size"), size)
        df, found = looked_up(df, pairs, self.weights.select("value", F.struct("to", "w").alias("to")), self.broadcast)
        values = F.transform(found, lambda p: F.when(p["n"]["v"] == 0, F.lit(0.0)).otherwise(p["n"]["v"] * p["to"]["w"]))
        return df, F.struct(F.col(name).alias("size"), F.transform(found, lambda p: p["to"]["to"]).alias("indices"), values.alias("values")).cast(SPARSE)


class CountsWithTfidf(Encoder):
    """A CountVectorizer and the TfidfTransformer after it as one step: texts are taken apart once to fit and once to encode."""

    numbers_values = True

    def __init__(self, counts: CountVectorizer, tfidf: TfidfTransformer):
        self.counts, self.tfidf = counts, tfidf

    def accepts(self, kind: T.DataType) -> None:
        self.counts.accepts(kind)

    def learn_values(self, values: DataFrame) -> None:
        self.counts.learn_values(values)
        self.tfidf.take(self.counts.values.select("pos", "have"), values.count())
        self.tfidf.of = self.counts.values

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        if self.counts.values is None or self.tfidf.of is not self.counts.values or self.counts.n <= DENSE:
            return self.tfidf.encode(*self.counts.encode(df, x))  # fitted apart, or dense
        return self.counts.sparse(df, x, self.tfidf.weight())


def steps(encoders: list[Encoder]) -> list[Encoder]:
    """A chain's encoders, with those that work as one step put together."""
    out: list[Encoder] = []
    for e in encoders:
        if isinstance(e, TfidfTransformer) and out and isinstance(out[-1], CountVectorizer):
            e = CountsWithTfidf(out.pop(), e)
        out.append(e)
    return out


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def present(values: DataFrame) -> DataFrame:
    """values (value: vectors, diff) -> (pos, have): by position, the sum of diff of the rows that have something there."""
    kind = values.schema["value"].dataType
    rows = values.filter("value IS NOT NULL")
    if is_sparse(kind):
        apart = rows.select("diff", F.inline(F.arrays_zip("value.indices", "value.values")).alias("pos", "v"))
    else:
        apart = rows.select("diff", F.posexplode("value").alias("pos", "v"))
    return apart.filter(F.abs(F.col("v")) >= 1e-10).groupBy("pos").agg(F.sum("diff").cast("long").alias("have"))
