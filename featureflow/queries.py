"""Queries over the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featureflow.functions.capacity import capacity
from featureflow.functions.storage import shared_dir, written
from featureflow.operators.categorical import OneHotEncoder, OrdinalEncoder
from featureflow.operators.scalers import KBinsDiscretizer, MinMaxScaler, StandardScaler
from featureflow.operators.stateless import FunctionEncoder, HashVectorizer, Passthrough, PolynomialFeatures
from featureflow.operators.text import CountVectorizer, TfidfTransformer, tfidf_table
from featureflow.plans import ready
from featureflow.plans.compose import MultiColumnEncoder, Pipeline, auto_encoder
from featureflow.sources.readers import modulo_rows, parse_number, random_texts, typed, watch
from featureflow.streaming.incremental import IncrementalEncoder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def six(c: str | Column) -> Column:
    """Rounded to six decimals as SQL's round does it, on the number times 10^6, halves away from zero: last bits depend on the order of summing."""
    millionths = (F.col(c) if isinstance(c, str) else c) * 1e6
    near = F.rint(millionths)
    return F.when(F.abs(millionths - near) == 0.5, millionths + F.signum(millionths) * 0.5).otherwise(near) / 1e6 + 0.0


def long_form(df: DataFrame, *keys: str, vector: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "value"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, round((l_quantity - m) / v, 6) + 0.0 AS z FROM lineitem, (SELECT avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem)")
def standard_scaler(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return StandardScaler().fit_transform(df, "l_quantity", "z").withColumn("z", six("z"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, round((l_extendedprice - m) / v, 9) + 0.0 AS z FROM lineitem, (SELECT round(avg(l_extendedprice) / 0.01) * 0.01 AS m, round(var_pop(l_extendedprice) / 10.0) * 10.0 AS v FROM lineitem)")
def standard_scaler_rounded(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return StandardScaler(-2, 1).fit_transform(df, "l_extendedprice", "z").withColumn("z", F.round("z", 9) + 0.0)


@query("SELECT r_regionkey, 'NaN'::DOUBLE AS z, 'NaN'::DOUBLE AS s, 0.0::DOUBLE AS b FROM region")
def constant_column(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "region", "r_regionkey").withColumn("one", F.lit(1.0))
    m = MultiColumnEncoder([("one", StandardScaler()), ("one", MinMaxScaler()), ("one", KBinsDiscretizer(3))]).fit(df)
    return m.columns(df, ["r_regionkey"]).withColumnsRenamed({"e0": "z", "e1": "s", "e2": "b"})


@query("SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 9) AS s FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def minmax_scaler(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return MinMaxScaler().fit_transform(df, "o_totalprice", "s").select("o_orderkey", F.round("s", 9).alias("s"))


@query("SELECT c_custkey, least(trunc((c_acctbal - lo) / (hi - lo) * 4.0), 3.0) + 0.0 AS bin FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def kbins(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return KBinsDiscretizer(4).fit_transform(df, "c_acctbal", "bin").select("c_custkey", "bin")


@query("SELECT c_custkey, least(trunc((c_acctbal - lo) / (hi - lo) * 4.0), 3.0) + 0.0 AS bin FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_acctbal BETWEEN 1000 AND 4000)")
def kbins_out_of_range(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return KBinsDiscretizer(4).fit(df.filter("c_acctbal BETWEEN 1000 AND 4000"), "c_acctbal").transform(df, "c_acctbal", "bin").select("c_custkey", "bin")


@query("SELECT o_orderkey, coalesce(p, -1.0)::DOUBLE AS code FROM orders LEFT JOIN (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS p FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)) ON v = o_orderpriority")
def ordinal(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return OrdinalEncoder().fit_transform(df, "o_orderpriority", "code").select("o_orderkey", "code")


@query("SELECT o_orderkey, coalesce(p, -1.0)::DOUBLE AS code FROM orders LEFT JOIN (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS p FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority NOT LIKE '2%')) ON v = o_orderpriority")
def ordinal_unseen(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    seen = df.filter("o_orderkey % 2 = 0 AND o_orderpriority NOT LIKE '2%'")
    return OrdinalEncoder().fit(seen, "o_orderpriority").transform(df, "o_orderpriority", "code").select("o_orderkey", "code")


def _width_sql(count: str) -> str:
    """The capacity of a count up to two million, as SQL."""
    widths = [1]
    while widths[-1] < 2_000_000:
        widths.append(capacity(widths[-1] + 1))
    rows = ", ".join(f"({w})" for w in widths)
    return f"(SELECT min(w) FROM (VALUES {rows}) t(w) WHERE w >= ({count}))"


def _one_hot_sql(tab: str, key: str, col: str, seen: str = "true") -> str:
    vocab = f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS p FROM (SELECT DISTINCT {col} AS v FROM {tab} WHERE {seen}))"
    width = _width_sql(f"SELECT count(DISTINCT {col}) FROM {tab} WHERE {seen}")
    return f"SELECT {key}, pos::INT AS pos, (CASE WHEN p = pos THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM {tab} LEFT JOIN {vocab} ON v = {col}, (SELECT unnest(range({width})) AS pos)"


@query(_one_hot_sql("customer", "c_custkey", "c_mktsegment"))
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    return long_form(OneHotEncoder().fit_transform(df, "c_mktsegment", "v"), "c_custkey")


@query(_one_hot_sql("part", "p_partkey", "p_brand", "p_partkey % 2 = 0 AND p_brand NOT LIKE '%5'"))
def one_hot_unseen(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part", "p_partkey", "p_brand")
    seen = df.filter("p_partkey % 2 = 0 AND p_brand NOT LIKE '%5'")
    return long_form(OneHotEncoder().fit(seen, "p_brand").transform(df, "p_brand", "v"), "p_partkey")


def _tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\s\p{{Z}}\x0b\x{{85}}]+'), lambda t: t <> '')"


def _counts_sql(tab: str, key: str, col: str) -> str:
    """k (key, t, n): token counts; voc (t, pos)."""
    return f"WITH k AS (SELECT {key}, t, count(*) AS n FROM (SELECT {key}, unnest({_tokens(col)}) AS t FROM {tab}) GROUP BY ALL), voc AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pos FROM (SELECT DISTINCT t FROM k))"


def _dense_sql(tab: str, key: str, col: str, value: str) -> str:
    return f"{_counts_sql(tab, key, col)} SELECT {key}, g.pos::INT AS pos, ({value})::DOUBLE AS value FROM {tab} CROSS JOIN (SELECT unnest(range({_width_sql('SELECT count(*) FROM voc')})) AS pos) g LEFT JOIN voc ON voc.pos = g.pos LEFT JOIN k USING ({key}, t)"


@query(_dense_sql("part", "p_partkey", "p_name", "coalesce(n, 0)"))
def count_vectorizer(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part", "p_partkey", "p_name")
    return long_form(CountVectorizer().fit_transform(df, "p_name", "v"), "p_partkey")


@query(_dense_sql("part", "p_partkey", "p_name", "CASE WHEN n > 0 THEN 1 ELSE 0 END"))
def count_vectorizer_binary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part", "p_partkey", "p_name")
    return long_form(CountVectorizer(binary=True).fit_transform(df, "p_name", "v"), "p_partkey")


@query(f"{_counts_sql('documents', 'doc_id', 'text')} SELECT doc_id, pos::INT AS pos, n::DOUBLE AS value FROM k JOIN voc USING (t)")
def count_vectorizer_documents(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents", "doc_id", "text")
    return CountVectorizer().fit(df, "text").table(df, "doc_id", "text")


def _hash_sql(value: str) -> str:
    h = "('0x' || substr(md5(t), 1, 8))::BIGINT % 16"
    return f"WITH k AS (SELECT p_partkey, {h} AS pos, count(*) AS n FROM (SELECT p_partkey, unnest({_tokens('p_name')}) AS t FROM part) GROUP BY ALL) SELECT p_partkey, g.pos::INT AS pos, ({value})::DOUBLE AS value FROM part CROSS JOIN (SELECT unnest(range(16)) AS pos) g LEFT JOIN k USING (p_partkey, pos)"


@query(_hash_sql("coalesce(n, 0)"))
def hash_vectorizer(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part", "p_partkey", "p_name")
    return long_form(HashVectorizer(16, how="md5").transform(df, "p_name", "v"), "p_partkey")


@query(_hash_sql("CASE WHEN n > 0 THEN 1 ELSE 0 END"))
def hash_vectorizer_binary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part", "p_partkey", "p_name")
    return long_form(HashVectorizer(16, True, "md5").transform(df, "p_name", "v"), "p_partkey")


def _idf_sql(tab: str, key: str, col: str, base: str) -> str:
    return f"{_counts_sql(tab, key, col)}, w AS (SELECT t, ({base}) AS a, (SELECT count(*) FROM {tab}) AS nn FROM (SELECT t, count(*) AS have FROM k GROUP BY t)) SELECT {key}, t AS token, round(n * (CASE WHEN a > 0 THEN ln(nn / a) ELSE 0 END), 6) + 0.0 AS value FROM k JOIN w USING (t)"


ABSENT = "(SELECT count(*) FROM {0}) - have"


@query(_dense_sql("part", "p_partkey", "p_name", "round(coalesce(n, 0) * coalesce((SELECT CASE WHEN count(*) < (SELECT count(*) FROM part) THEN ln((SELECT count(*) FROM part) / ((SELECT count(*) FROM part) - count(*))) ELSE 0 END FROM k kk WHERE kk.t = voc.t), 0), 6)"))
def tfidf_absent(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part", "p_partkey", "p_name")
    out = Pipeline([CountVectorizer(), TfidfTransformer()]).fit(df, "p_name").transform(df, "p_name", "v")
    return long_form(out, "p_partkey").withColumn("value", six("value"))


@query(_idf_sql("documents", "doc_id", "text", ABSENT.format("documents")))
def tfidf_documents(spark: SparkSession, d: str) -> DataFrame:
    return tfidf_table(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").withColumn("value", six("value"))


@query(_idf_sql("part", "p_partkey", "p_name", f"(round(({ABSENT.format('part')}) / 10.0) * 10.0)::BIGINT"))
def tfidf_rounded(spark: SparkSession, d: str) -> DataFrame:
    return tfidf_table(table(spark, d, "part", "p_partkey", "p_name"), "p_partkey", "p_name", rounding=1).withColumn("value", six("value"))


@query(_idf_sql("part", "p_partkey", "p_name", "have"))
def tfidf_present(spark: SparkSession, d: str) -> DataFrame:
    return tfidf_table(table(spark, d, "part", "p_partkey", "p_name"), "p_partkey", "p_name", "present").withColumn("value", six("value"))


@query("SELECT p_partkey, [1.0, x, x * x, x * x * x]::DOUBLE[] AS v FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part)")
def polynomial(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part", "p_partkey", "p_size")
    return PolynomialFeatures(0, 3).transform(df, "p_size", "v").select("p_partkey", "v")


@query("SELECT p_partkey, [1.0, y, x, y * y, x * y, x * x]::DOUBLE[] AS v FROM (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part)")
def polynomial_multi(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("pair"))
    return PolynomialFeatures(0, 2, features=2).transform(df, "pair", "v").select("p_partkey", "v")


@query("SELECT c_custkey, c_acctbal AS same, c_acctbal * 2.0 + 1.0 AS twice, abs(c_acctbal) AS size FROM customer")
def function_and_passthrough(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer", "c_custkey", "c_acctbal")
    m = MultiColumnEncoder([("c_acctbal", Passthrough()), ("c_acctbal", FunctionEncoder(lambda c: c * 2.0 + 1.0)), ("c_acctbal", FunctionEncoder(lambda s: s.abs(), "double"))]).fit(df)
    return m.columns(df, ["c_custkey"]).withColumnsRenamed({"e0": "same", "e1": "twice", "e2": "size"})


_BINS = "least(trunc((o_totalprice - lo) / (hi - lo) * {0}), {1}) + 0.0"
_RANGE = "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"


@query(f"WITH b AS (SELECT o_orderkey, {_BINS.format('5.0', '4.0')} AS b FROM orders, {_RANGE}) SELECT o_orderkey, (SELECT count(*) FROM (SELECT DISTINCT b FROM b) x WHERE x.b < b.b)::DOUBLE AS code FROM b")
def pipeline_kbins_ordinal(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return Pipeline([KBinsDiscretizer(5), OrdinalEncoder()]).fit(df, "o_totalprice").transform(df, "o_totalprice", "code").select("o_orderkey", "code")


@query(f"WITH b AS (SELECT o_orderkey, {_BINS.format('3.0', '2.0')} AS b FROM orders, {_RANGE}), v AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS p FROM (SELECT DISTINCT b FROM b)) SELECT o_orderkey, pos::INT AS pos, (CASE WHEN p = pos THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM b JOIN v USING (b), (SELECT unnest(range({_width_sql('SELECT count(*) FROM v')})) AS pos)")
def pipeline_minmax_kbins_onehot(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    p = Pipeline([MinMaxScaler(), Pipeline([KBinsDiscretizer(3), OneHotEncoder()])])
    return long_form(p.fit(df, "o_totalprice").transform(df, "o_totalprice", "v"), "o_orderkey")


_FLAGS = f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS p FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)), (SELECT {_width_sql('SELECT count(DISTINCT l_returnflag) FROM lineitem')} AS w)"


@query(
    f"""SELECT l_orderkey, l_linenumber, [round((l_quantity - m) / v0, 6) + 0.0, round((l_extendedprice - lo) / (hi - lo), 6) + 0.0, least(trunc((l_discount - dl) / (dh - dl) * 4.0), 3.0) + 0.0]
    || list_transform(range(w), lambda i: CASE WHEN i = p THEN 1.0 ELSE 0.0 END)::DOUBLE[] || [round(l_tax, 6) + 0.0]::DOUBLE[] AS v
    FROM lineitem, (SELECT round(avg(l_quantity) / 0.1) * 0.1 AS m, round(var_pop(l_quantity) / 0.1) * 0.1 AS v0, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_discount) AS dl, max(l_discount) AS dh FROM lineitem), {_FLAGS} WHERE v = l_returnflag"""
)
def multi_column_presentation(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_tax")
    m = ready.presentation(("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_tax")).fit(df)
    return m.transform(df, ["l_orderkey", "l_linenumber"], "v").withColumn("v", F.transform("v", lambda x: F.round(x, 6) + 0.0))


@query(f"SELECT c_custkey, [round((c_acctbal - m) / va, 6) + 0.0] || list_transform(range(w), lambda i: CASE WHEN i = p THEN 1.0 ELSE 0.0 END)::DOUBLE[] AS v FROM customer, (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) AS va FROM customer), (SELECT v AS val, row_number() OVER (ORDER BY v) - 1 AS p FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)), (SELECT {_width_sql('SELECT count(DISTINCT c_mktsegment) FROM customer')} AS w) WHERE val = c_mktsegment")
def standard_plus_onehot(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    m = ready.standard_and_one_hot(("c_acctbal", "c_mktsegment")).fit(df)
    return m.transform(df, ["c_custkey"], "v").withColumn("v", F.transform("v", lambda x: F.round(x, 6) + 0.0))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((CASE WHEN v{c} = 0 THEN CASE WHEN {c} > m{c} THEN 'inf'::DOUBLE WHEN {c} < m{c} THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE ({c} - m{c}) / v{c} END), 6) + 0.0 AS z{i}" for i, c in enumerate(_NUMBERS))
    + " FROM lineitem, (SELECT " + ", ".join(f"round(avg({c}) / 0.01) * 0.01 AS m{c}, round(var_pop({c}) / 0.1) * 0.1 AS v{c}" for c in _NUMBERS) + " FROM lineitem)"
)
def scale_all_numeric(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", *_NUMBERS)
    m = ready.scale_all(df.select(*_NUMBERS)).fit(df)
    out = m.columns(df, ["l_orderkey", "l_linenumber", *_NUMBERS])
    # Where the variance is 0, the SQL has NaN for null too, where the encoder leaves null.
    z = [F.when(F.col(c).isNull(), F.lit(float("nan"))).otherwise(six(f"e{i}")) if scaler.meta[1] == 0 else six(f"e{i}") for i, (c, (scaler,)) in enumerate(m.chains)]
    return out.select("l_orderkey", "l_linenumber", *[x.alias(f"z{i}") for i, x in enumerate(z)])


@query(f"SELECT c_custkey, list_transform(range(w), lambda i: CASE WHEN i = p THEN 1.0 ELSE 0.0 END)::DOUBLE[] || [c_acctbal]::DOUBLE[] AS v FROM customer, (SELECT v AS val, row_number() OVER (ORDER BY v) - 1 AS p FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)), (SELECT {_width_sql('SELECT count(DISTINCT c_mktsegment) FROM customer')} AS w) WHERE val = c_mktsegment")
def auto_encode(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer")
    return auto_encoder(df, ["c_custkey", "c_name", "c_nationkey"]).fit(df).transform(df, ["c_custkey"], "v")


@query(r"SELECT event_id, coalesce(CASE WHEN regexp_full_match(trim(x), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN try_cast(trim(x) AS DOUBLE) END, -1.0) AS number FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' ' || event_id || '.5 ' WHEN event_id % 3 = 1 THEN event_type ELSE event_id || 'd' END AS x FROM events)")
def parse_numeric_default(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events", "event_id", "event_type")
    cell = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_id", F.lit(".5 "))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat("event_id", F.lit("d")))
    return df.select("event_id", parse_number(cell).alias("number"))


@query("SELECT p_partkey::VARCHAR::DOUBLE AS a, p_name AS b, p_retailprice::DOUBLE AS c FROM part")
def parse_mixed(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part")
    return typed(df.select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("a"), F.concat("p_name", F.lit(" ")).alias("b"), F.col("p_retailprice").cast("string").alias("c")))


@query("SELECT i AS row_id, [round((i % 10 - 4.5) / 8.25, 6), (i % 5) / 4.0, least(trunc((i % 8) / 7.0 * 4.0), 3.0)]::DOUBLE[] AS v FROM range(1000) t(i)")
def synthetic_three_numbers(spark: SparkSession, d: str) -> DataFrame:
    df = modulo_rows(spark, 1000, [10, 5, 8])
    return ready.three_numbers(("c0", "c1", "c2")).fit(df).transform(df, ["row_id"], "v").withColumn("v", F.transform("v", lambda x: F.round(x, 6)))


_EPOCH = "event_id % 4"


def _changes(inc: IncrementalEncoder, parts: list[DataFrame], last: bool = False) -> DataFrame:
    """All that the epochs put out, or the last one only."""
    outputs = [written(inc.process(e, part), "output") for e, part in enumerate(parts)]
    out = outputs[-1] if last else outputs[0]
    for o in () if last else outputs[1:]:
        out = out.unionByName(o)
    return out


def _state_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"


def _incremental(spark: SparkSession, d: str, retract: bool, last: bool = False) -> DataFrame:
    """The sum of all changes put out over epochs of the events, of which some are taken back in the last; last: only what the last epoch puts out."""
    df = table(spark, d, "events", "event_id", "event_type", "value")
    config = [("value", StandardScaler()), ("value", MinMaxScaler()), ("value", KBinsDiscretizer(4))]
    inc = IncrementalEncoder(spark, config, "event_id long, event_type string, value double", _state_path(spark))
    parts = [df.filter(f"{_EPOCH} = {e}").withColumn("diff", F.lit(1)) for e in range(4)]
    if retract:
        parts.append(df.filter("event_id % 7 = 0").withColumn("diff", F.lit(-1)))
    out = _changes(inc, parts, last)
    summed = out.groupBy("event_id", "event_type", "value", "e1", "e2", six("e0").alias("z")).agg(F.sum("diff").alias("n")).filter("n <> 0")
    return summed.select("event_id", "z", F.round("e1", 9).alias("s"), F.col("e2").alias("bin"), "n")


def _incremental_sql(live: str) -> str:
    return f"SELECT event_id, round((value - m) / v, 6) + 0.0 AS z, round((value - lo) / (hi - lo), 9) AS s, least(trunc((value - lo) / (hi - lo) * 4.0), 3.0) + 0.0 AS bin, 1::BIGINT AS n FROM events, (SELECT avg(value) AS m, var_pop(value) AS v, min(value) AS lo, max(value) AS hi FROM events WHERE {live}) WHERE {live}"


@query(_incremental_sql("true"))
def incremental_final_state(spark: SparkSession, d: str) -> DataFrame:
    return _incremental(spark, d, False)


@query(_incremental_sql("event_id % 7 <> 0"))
def retraction_final_state(spark: SparkSession, d: str) -> DataFrame:
    return _incremental(spark, d, True)


_DELTA_SQL = f"""
SELECT event_id, z, s, bin, sum(n)::BIGINT AS n FROM ({_incremental_sql("true")} UNION ALL
    SELECT event_id, z, s, bin, -n FROM ({_incremental_sql("event_id % 4 < 3")})) GROUP BY ALL HAVING sum(n) <> 0
"""


@query(_DELTA_SQL)
def incremental_delta(spark: SparkSession, d: str) -> DataFrame:
    """What the last epoch changes in the encoded rows."""
    return _incremental(spark, d, False, last=True)


@query("SELECT event_id, round((value - m) / v, 4) + 0.0 AS z, 1::BIGINT AS n FROM events, (SELECT avg(value) AS m, var_pop(value) AS v FROM events WHERE event_id % 7 <> 0) WHERE event_id % 7 <> 0")
def incremental_offset(spark: SparkSession, d: str) -> DataFrame:
    """Values far from 0, some of which are taken back: their variance isn't lost in their squares."""
    df = table(spark, d, "events", "event_id", "value").withColumn("value", F.col("value") + 1e9)
    inc = IncrementalEncoder(spark, [("value", StandardScaler())], "event_id long, value double", _state_path(spark))
    parts = [df.filter(f"event_id % 3 = {e}").withColumn("diff", F.lit(1)) for e in range(3)]
    out = _changes(inc, [*parts, df.filter("event_id % 7 = 0").withColumn("diff", F.lit(-1))])
    summed = out.groupBy("event_id", F.round("e0", 4).alias("z")).agg(F.sum("diff").alias("n")).filter("n <> 0")
    return summed.select("event_id", (F.col("z") + 0.0).alias("z"), "n")


@query(
    f"""WITH RECURSIVE c AS (SELECT count(DISTINCT p_brand) FILTER (p_brand < 'Brand#3') AS live, {_width_sql("SELECT count(DISTINCT p_brand) FROM part")} AS w FROM part),
    r AS (SELECT live, w::INT AS w FROM c UNION ALL SELECT live, ceil(0.66::DOUBLE * w)::INT FROM r WHERE live < floor(0.66::DOUBLE * w))
    SELECT p_partkey, (SELECT min(w) FROM r) AS width, 1.0::DOUBLE AS hot, count(*) OVER (PARTITION BY p_brand) AS of_place, count(*) OVER (PARTITION BY p_brand) AS of_value FROM part WHERE p_brand < 'Brand#3'"""
)
def incremental_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary that grows over epochs, and shrinks when most of its values go: each live value has a place of its own."""
    df = table(spark, d, "part", "p_partkey", "p_brand")
    inc = IncrementalEncoder(spark, [("p_brand", OneHotEncoder()), ("p_brand", OrdinalEncoder())], "p_partkey long, p_brand string", _state_path(spark))
    parts = [df.filter("p_brand < 'Brand#2' AND p_partkey % 2 = 0"), df.filter("p_brand >= 'Brand#4'"), df.filter("p_brand >= 'Brand#2' AND p_brand < 'Brand#4' OR p_brand < 'Brand#2' AND p_partkey % 2 <> 0")]
    out = _changes(inc, [*[p.withColumn("diff", F.lit(1)) for p in parts], df.filter("p_brand >= 'Brand#3'").withColumn("diff", F.lit(-1))])
    live = out.groupBy("p_partkey", "p_brand", "e0", "e1").agg(F.sum("diff").alias("n")).filter("n <> 0")
    place = (F.array_position("e0", 1.0) - 1).cast("int")
    counted = lambda key: F.count("*").over(Window.partitionBy(key))
    return live.select("p_partkey", F.size("e0").alias("width"), F.element_at("e0", F.col("e1").cast("int") + 1).alias("hot"), counted(place).alias("of_place"), counted(F.col("p_brand")).alias("of_value"))


_NAMES = "(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' extra' || (p_partkey % 5) ELSE p_name END AS t FROM part WHERE p_partkey % 7 <> 0)"


@query(
    f"""WITH k AS (SELECT p_partkey, t, count(*) AS n FROM (SELECT p_partkey, unnest({_tokens("t")}) AS t FROM {_NAMES}) GROUP BY ALL), c AS (SELECT count(*) AS nn FROM {_NAMES}),
    w AS (SELECT t, CASE WHEN nn > count(*) THEN ln(nn / (nn - count(*))) ELSE 0 END AS w FROM k, c GROUP BY t, nn)
    SELECT p_partkey, round(n * w, 6) + 0.0 AS value, n::DOUBLE AS count, 1::BIGINT AS n FROM k JOIN w USING (t) WHERE w <> 0"""
)
def incremental_text(spark: SparkSession, d: str) -> DataFrame:
    """Token counts and TF-IDF over epochs, of which the second brings new words and the third takes rows away: what isn't 0 in the rows' vectors."""
    df = table(spark, d, "part", "p_partkey", "p_name")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" extra"), (F.col("p_partkey") % 5).cast("string"))).otherwise(F.col("p_name"))
    df = df.select("p_partkey", name.alias("t"))
    inc = IncrementalEncoder(spark, [("t", Pipeline([CountVectorizer(), TfidfTransformer()])), ("t", CountVectorizer())], "p_partkey long, t string", _state_path(spark))
    parts = [df.filter("p_partkey % 3 <> 0").withColumn("diff", F.lit(1)), df.filter("p_partkey % 3 = 0").withColumn("diff", F.lit(1)), df.filter("p_partkey % 7 = 0").withColumn("diff", F.lit(-1))]
    out = _changes(inc, parts)
    live = out.groupBy("p_partkey", F.transform("e0", six).alias("e0"), "e1").agg(F.sum("diff").alias("n")).filter("n <> 0")
    return live.select("p_partkey", F.inline(F.arrays_zip("e0", "e1")).alias("value", "count"), "n").filter("value <> 0")


@query(
    """WITH live AS (SELECT event_id, value FROM events WHERE event_id % 7 <> 0),
    b AS (SELECT event_id, least(trunc((value - lo) / (hi - lo) * 5.0), 4.0) AS five, least(trunc((value - lo) / (hi - lo) * 3.0), 2.0) AS three FROM live, (SELECT min(value) AS lo, max(value) AS hi FROM live))
    SELECT event_id, count(*) OVER (PARTITION BY five) AS in_bin_of_five, count(*) OVER (PARTITION BY three) AS in_bin_of_three, 1.0::DOUBLE AS hot FROM b"""
)
def incremental_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Pipelines of two and three stages over epochs: places of bins may be any, so rows show how many share theirs."""
    df = table(spark, d, "events", "event_id", "value")
    config = [("value", Pipeline([KBinsDiscretizer(5), OrdinalEncoder()])), ("value", Pipeline([MinMaxScaler(), Pipeline([KBinsDiscretizer(3), OneHotEncoder()])]))]
    inc = IncrementalEncoder(spark, config, "event_id long, value double", _state_path(spark))
    parts = [df.filter("event_id % 2 = 0 AND value < 50").withColumn("diff", F.lit(1)), df.filter("NOT (event_id % 2 = 0 AND value < 50)").withColumn("diff", F.lit(1)), df.filter("event_id % 7 = 0").withColumn("diff", F.lit(-1))]
    live = _changes(inc, parts).groupBy("event_id", "e0", "e1").agg(F.sum("diff").alias("n")).filter("n <> 0")
    counted = lambda key: F.count("*").over(Window.partitionBy(key))
    return live.select("event_id", counted("e0").alias("in_bin_of_five"), counted(F.array_position("e1", 1.0)).alias("in_bin_of_three"), F.aggregate("e1", F.lit(0.0), lambda a, x: a + x).alias("hot"))


@query(f"{_idf_sql('documents', 'doc_id', 'text', ABSENT.format('documents')).replace('t AS token', 'pos::INT AS pos').replace('JOIN w USING (t)', 'JOIN w USING (t) JOIN voc USING (t)')}")
def tfidf_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Counting and TF-IDF as a pipeline, over a vocabulary that is too large for dense vectors."""
    df = table(spark, d, "documents", "doc_id", "text")
    out = ready.text_pipeline().fit(df, "text").transform(df, "text", "v")
    return out.select("doc_id", F.inline(F.arrays_zip("v.indices", "v.values")).alias("pos", "value")).withColumn("value", six("value"))


@query("SELECT p_partkey, [x, x * x, x * x * x]::DOUBLE[] AS v FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey = 7)")
def polynomial_ready(spark: SparkSession, d: str) -> DataFrame:
    """Powers 1 to 3, with a row that is there twice."""
    df = table(spark, d, "part", "p_partkey", "p_size")
    df = df.unionByName(df.filter("p_partkey = 7"))
    return ready.polynomial("p_size").fit(df).transform(df, ["p_partkey"], "v")


@query(f"{_counts_sql('part', 'p_partkey', 'p_name')}, w AS (SELECT t, CASE WHEN a > 0 THEN ln(nn / a) ELSE 0 END AS w FROM (SELECT t, (SELECT count(*) FROM part) AS nn, (round(((SELECT count(*) FROM part) - count(*)) / 0.01) * 0.01)::BIGINT AS a FROM k GROUP BY t)) SELECT p_partkey, pos::INT AS pos, round(n * w, 6) + 0.0 AS value FROM k JOIN w USING (t) JOIN voc USING (t) WHERE w <> 0")
def text_features(spark: SparkSession, d: str) -> DataFrame:
    """The ready-made text pipeline, whose rounding to hundredths leaves counts as they are."""
    df = table(spark, d, "part", "p_partkey", "p_name")
    out = ready.text_features("p_name").fit(df).transform(df, ["p_partkey"], "v")
    return long_form(out, "p_partkey").withColumn("value", six("value")).filter("value <> 0")


@query("SELECT i AS row_id, true AS words_fit, true AS known FROM range(500) t(i)")
def random_texts_watched(spark: SparkSession, d: str) -> DataFrame:
    """Random texts, watched on their way: five to ten words each, all of them from the list."""
    words = ["one", "two", "three", "four"]
    df = watch(random_texts(spark, 500, words, seed=3), "texts")
    parts = F.split("text", " ")
    return df.select("row_id", F.size(parts).between(5, 10).alias("words_fit"), (F.size(F.array_except(parts, F.lit(words))) == 0).alias("known"))
