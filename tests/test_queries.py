"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order], key=str), sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_scaling_of_nulls_equals_its_sql(spark, tmp_path):
    """Nulls of columns whose variance is rounded to 0, and of others; a column without values."""
    con = duckdb.connect()
    some = "CASE WHEN l_partkey % {} <> 0 THEN {} END AS {}"
    for i, replaced in enumerate([[some.format(k, c, c) for k, c in ((3, "l_quantity"), (5, "l_extendedprice"), (7, "l_discount"), (4, "l_tax"))], ["NULL::DOUBLE AS l_tax", "3.3::DOUBLE AS l_quantity"]]):
        at = tmp_path / str(i)
        at.mkdir()
        con.execute(f"COPY (SELECT * REPLACE ({', '.join(replaced)}) FROM '{SF}/lineitem.parquet') TO '{at}/lineitem.parquet'")
        con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet'")
        df = __spark_entry__.queries()["scale_all_numeric"](spark, str(at))
        want = con.execute(__spark_entry__.oracle_sql()["scale_all_numeric"])
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_six_rounds_as_sql(spark, duck):
    from featureflow.queries import six

    ties = [(k + 0.5) / 1e6 * sign for k in (0, 1, 2, 7, 24, 1562, 98320, 999999, 123456789) for sign in (1, -1)]
    xs = [math.nextafter(x, to) for x in ties for to in (x, 0.0, 2 * x)] + [0.0, -0.0, -1e-9, 3e9 + 1e-6, -7.0, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x double")
    found = [r.y for r in df.select("i", six("x").alias("y")).orderBy("i").collect()]
    want = [duck.execute("SELECT round(?::DOUBLE, 6) + 0.0", [x]).fetchall()[0][0] for x in xs]
    assert [repr(x) for x in found] == [repr(x) for x in want]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir(SF)
