"""Encoders on hand-made tables, whose results were worked out by hand."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featureflow.functions.capacity import capacity, resized
from featureflow.functions.numeric import ieee_div, round_to
from featureflow.functions.text import tokens
from featureflow.operators.base import NotFittedError
from featureflow.operators.categorical import OneHotEncoder, OrdinalEncoder
from featureflow.operators.scalers import KBinsDiscretizer, MinMaxScaler, StandardScaler
from featureflow.operators.stateless import FunctionEncoder, HashVectorizer, Passthrough, PolynomialFeatures, combinations
from featureflow.operators.text import CountVectorizer, TfidfTransformer, tfidf_table
from featureflow.plans import ready
from featureflow.plans.compose import MultiColumnEncoder, Pipeline, auto_encoder
from featureflow.sources.readers import modulo_rows, random_texts, read_mixed_csv, read_numeric_csv
from featureflow.streaming.incremental import IncrementalEncoder, Moments


def values(df, column="encoded"):
    return [r[column] for r in df.orderBy("row_id").collect()]


def column(spark, xs, kind="double"):
    return spark.createDataFrame(list(enumerate(xs)), f"row_id long, x {kind}")


def test_scalers(spark):
    ten = modulo_rows(spark, 10, [0, 5])
    assert values(StandardScaler().fit_transform(ten, "c0")) == [(i - 4.5) / 8.25 for i in range(10)]
    assert values(MinMaxScaler().fit_transform(ten, "c1")) == [(i % 5) / 4 for i in range(10)]
    assert values(KBinsDiscretizer(3).fit_transform(ten, "c1")) == [0, 0, 1, 2, 2] * 2


def test_constant_columns_and_rounding_to_zero(spark):
    one = column(spark, [2.0, 2.0])
    assert all(math.isnan(x) for x in values(StandardScaler().fit_transform(one, "x")))
    assert all(math.isnan(x) for x in values(MinMaxScaler().fit_transform(one, "x")))
    assert values(KBinsDiscretizer(3).fit_transform(one, "x")) == [0.0, 0.0]
    near = values(StandardScaler(0, 1).fit_transform(column(spark, [1.0, 2.0, 3.0]), "x"))
    assert near[0] == -math.inf and math.isnan(near[1]) and near[2] == math.inf


def test_bins_out_of_range_and_nulls(spark):
    e = KBinsDiscretizer(4).fit(column(spark, [0.0, 10.0, None]), "x")
    assert values(e.transform(column(spark, [-12.0, -3.0, 5.0, 10.0, 25.0, None, float("nan")]), "x")) == [-4.0, -1.0, 2.0, 3.0, 3.0, None, 0.0]


def test_round_to():
    assert [round_to(x, 0) for x in (2.5, -2.5, 0.49)] == [3.0, -3.0, 0.0]
    assert round_to(1.2345, -2) == 123 * 0.01 and round_to(1.5, None) == 1.5 and math.isnan(round_to(math.nan, 1))


def test_ieee_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [1.5, None]


def test_numbering(spark):
    df = column(spark, ["b", "a", "b", "c"], "string")
    odd = column(spark, ["c", "z", None], "string")
    assert values(OrdinalEncoder().fit(df, "x").transform(odd, "x")) == [2.0, -1.0, -1.0]
    assert values(OneHotEncoder().fit(df, "x").transform(odd, "x")) == [[0, 0, 1], [0, 0, 0], [0, 0, 0]]
    assert [capacity(n) for n in (1, 2, 3, 4, 6, 9, 25)] == [1, 2, 3, 5, 8, 12, 27]
    assert resized(9, 8) == 12 and resized(3, 12) == 6 and resized(0, 1) == 1
    with pytest.raises(TypeError):
        OneHotEncoder().fit(spark.createDataFrame([(0, [1.0])], "row_id long, x array<double>"), "x")


def test_large_vocabularies_are_ranked_by_parts(spark, monkeypatch):
    from featureflow.operators import categorical

    monkeypatch.setattr(categorical, "ONE_TASK", 10)
    df = column(spark, [f"v{i:04d}" for i in range(500)], "string")
    assert values(OrdinalEncoder().fit_transform(df, "x")) == [float(i) for i in range(500)]


def test_tokens(spark):
    df = column(spark, [" a b　c ", "", None, " \t\n"], "string")
    assert values(df.withColumn("encoded", tokens(F.col("x")))) == [["a", "b", "c"], [], None, []]


def test_text_vectors(spark):
    df = column(spark, ["a b", "a c", "a a"], "string")
    assert values(CountVectorizer().fit_transform(df, "x")) == [[1, 1, 0], [1, 0, 1], [2, 0, 0]]
    assert values(CountVectorizer(True).fit(df, "x").transform(column(spark, ["a a z", None], "string"), "x")) == [[1, 0, 0], [0, 0, 0]]
    tfidf = Pipeline([CountVectorizer(), TfidfTransformer()])
    assert values(tfidf.fit_transform(df, "x")) == [[0, math.log(3 / 2), 0], [0, 0, math.log(3 / 2)], [0, 0, 0]]
    table = {(r.row_id, r.token): r.value for r in tfidf_table(df, "row_id", "x").collect()}
    assert table == {(0, "a"): 0, (0, "b"): math.log(3 / 2), (1, "a"): 0, (1, "c"): math.log(3 / 2), (2, "a"): 0}
    sparse = CountVectorizer().fit(df, "x").table(df, "row_id", "x").collect()
    assert {(r.row_id, r.pos): r.value for r in sparse} == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 2): 1, (2, 0): 2}
    hashed = values(HashVectorizer(4).transform(column(spark, ["a b a", None], "string"), "x"))
    assert sum(hashed[0]) == 3 and hashed[1] == [0] * 4
    assert max(values(HashVectorizer(1, True).transform(df, "x"))) == [1.0]


def test_stateless(spark):
    df = column(spark, [2.0, -1.0])
    assert values(PolynomialFeatures(0, 3).transform(df, "x")) == [[1, 2, 4, 8], [1, -1, 1, -1]]
    assert combinations(2, 0, 2) == [(), (1,), (0,), (1, 1), (0, 1), (0, 0)]
    pair = df.withColumn("x", F.array("x", F.lit(3.0)))
    assert values(PolynomialFeatures(0, 2, 2).transform(pair, "x")) == [[1, 3, 2, 9, 6, 4], [1, 3, -1, 9, -3, 1]]
    assert values(FunctionEncoder(lambda c: c + 1).transform(df, "x")) == [3.0, 0.0]
    assert values(FunctionEncoder(lambda s: s * 2, "double").transform(df, "x")) == [4.0, -2.0]
    assert values(Passthrough().transform(df, "x")) == [2.0, -1.0]
    with pytest.raises(ValueError):
        PolynomialFeatures(3, 1)


def test_unfitted_and_wrong_types(spark):
    df = column(spark, ["a"], "string")
    for e in (StandardScaler(), MinMaxScaler(), KBinsDiscretizer(2), OrdinalEncoder(), OneHotEncoder(), CountVectorizer(), TfidfTransformer()):
        with pytest.raises(NotFittedError):
            e.transform(df, "x")
    for e in (StandardScaler(), MinMaxScaler(), KBinsDiscretizer(2), TfidfTransformer()):
        with pytest.raises(TypeError):
            e.fit(df, "x")


def test_side_by_side(spark):
    df = modulo_rows(spark, 25, [5, 10, 8, 3, 0])
    m = ready.presentation(("c0", "c1", "c2", "c3", "c4")).fit(df)
    rows = m.transform(df, ["row_id"]).orderBy("row_id").collect()
    assert len(rows) == 25 and rows[4].vector == [(4 - 2.0) / 2.0, 4 / 9, 2.0, 0.0, 1.0, 0.0, 4.0]
    assert m.transform(df).columns == ["vector"]
    one = MultiColumnEncoder([(1, StandardScaler())]).fit_transform(df)
    assert one.schema["vector"].dataType.simpleString() == "double"
    twice = MultiColumnEncoder([("c0", Passthrough()), ("c0", Passthrough())]).fit_transform(df.union(df.limit(1)))
    assert twice.count() == 26
    with pytest.raises(ValueError):
        MultiColumnEncoder([])
    with pytest.raises(TypeError):
        MultiColumnEncoder([("c0", Passthrough()), ("t", Passthrough())]).fit_transform(df.withColumn("t", F.lit("x")))


def test_nested_pipelines(spark):
    df = spark.range(20).select(F.col("id").alias("c0"), (F.col("id") + 1).alias("c1"))
    got = ready.nested(("c0", "c1")).fit(df).transform(df, ["c0"]).orderBy("c0").collect()
    for r in got:
        third = min(int(r.c0 / 19 * 3), 2)
        assert r.vector == [min(int(r.c0 / 19 * 5), 4), *[1.0 if k == third else 0.0 for k in range(3)]]


def test_fitting_shares_one_pass(spark):
    df = modulo_rows(spark, 10, [5])
    asked = []
    plain = type(df).agg
    try:
        type(df).agg = lambda self, *a: asked.append(len(a)) or plain(self, *a)
        MultiColumnEncoder([("c0", StandardScaler()), ("c0", MinMaxScaler()), ("c0", KBinsDiscretizer(3))]).fit(df)
    finally:
        type(df).agg = plain
    assert asked == [4]


def test_csv_readers(spark):
    d = __file__.rsplit("/", 1)[0] + "/data"
    assert [tuple(r) for r in read_numeric_csv(spark, f"{d}/numeric.csv").collect()] == [(1.0, 2.5), (-1.0, -1.0), (3.0, -1.0), (-0.5, 1000.0)]
    mixed = read_mixed_csv(spark, f"{d}/mixed.csv")
    assert dict(mixed.dtypes) == {"age": "double", "job": "string", "code": "string", "gain": "double"}
    assert [r.job for r in mixed.collect()] == ["clerk", "nurse", "2"]
    assert auto_encoder(mixed, ["code"]).fit(mixed).transform(mixed).count() == 3


def test_random_texts_repeat(spark):
    words = ["x", "y"]
    a = random_texts(spark, 20, words, seed=1).collect()
    assert a == random_texts(spark, 20, words, seed=1).collect()
    assert all(5 <= len(r.text.split()) <= 10 for r in a)


def test_moments_with_rows_taken_away():
    m = Moments().add(3, 2.0, 2.0).add(-1, 3.0, 0.0)
    assert (m.n, m.mean) == (2, 1.5) and m.m2 == pytest.approx(0.5)
    assert m.add(-2, 1.5, -0.5) == Moments() and Moments().add(1, 5.0, 0.0) == Moments(1, 5.0, 0.0)


def make():
    return [("x", StandardScaler(-1, -1)), ("x", MinMaxScaler()), ("x", KBinsDiscretizer(4)), ("v", OrdinalEncoder()), ("v", OneHotEncoder()), ("x", Passthrough())]


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_add_up_to_a_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    inc = IncrementalEncoder(spark, make(), "id long, x double, v string", str(tmp_path))
    live, total = collections.Counter(), collections.Counter()
    for epoch in range(4):
        changes = []
        for _ in range(12):
            if live and rng.random() < 0.4:
                key = rng.choice(sorted(live))
                changes.append((*key, -1))
                live[key] -= 1
                live += collections.Counter()
            else:
                key = rng.randrange(99), float(rng.randrange(9)), rng.choice("abcdefgh")
                changes.append((*key, 1))
                live[key] += 1
        df = spark.createDataFrame(changes, "id long, x double, v string, diff long")
        for r in inc.process(epoch, df).collect():
            total[r.id, r.x, r.v, r.e0, r.e1, r.e2, r.e3, tuple(r.e4), r.e5] += r.diff
    total = {k: c for k, c in total.items() if c}
    rows = spark.createDataFrame([k for k, c in live.items() for _ in range(c)], "id long, x double, v string")
    want = collections.Counter((r.id, r.x, r.v, round(r.e0, 6), r.e1, r.e2, r.e5) for r in MultiColumnEncoder(make()).fit(rows).columns(rows, ["id", "x", "v"]).collect())
    got = collections.Counter()
    for k, c in total.items():
        got[k[0], k[1], k[2], round(k[3], 6), k[4], k[5], k[8]] += c
        assert k[7][int(k[6])] == 1 and sum(k[7]) == 1
    assert got == want
    assert len({(k[2], k[6]) for k in total}) == len({k[6] for k in total}) == len({k[2] for k in total})


def test_text_and_pipelines_follow_changes(spark, tmp_path):
    def config():
        return [("t", CountVectorizer()), ("t", Pipeline([CountVectorizer(), TfidfTransformer()])), ("x", Pipeline([KBinsDiscretizer(3), OneHotEncoder()])), ("x", MinMaxScaler())]

    kinds, names = "id long, t string, x double", ["id", "t", "x"]
    epochs = [
        [(1, "a b a", 1.0, 1), (2, "b c", 5.0, 2), (3, None, 2.0, 1)],
        [(4, "c d e new", 9.0, 1), (1, "a b a", 1.0, -1)],
        [(2, "b c", 5.0, -1), (5, "", None, 1)],
    ]
    live, total = collections.Counter(), collections.Counter()
    as_key = lambda r: (r.id, r.t, r.x, tuple(r.e0), tuple(r.e1), tuple(r.e2), r.e3)

    def by_place(rows):
        """Rows without their vectors, and what each place of the vectors holds in all rows: places may be any."""
        rows = sorted(rows.items(), key=lambda kv: (kv[0][0], str(kv[0][1])))
        places = [sorted(zip(*([round(v, 12) for v in k[j]] for k, _ in rows), strict=True)) for j in (3, 4, 5)]
        return [(*k[:3], k[6], n) for k, n in rows], places

    for epoch, changes in enumerate(epochs):
        inc = IncrementalEncoder(spark, config(), kinds, str(tmp_path))  # a new one, as after a restart
        for r in inc.process(epoch, spark.createDataFrame(changes, f"{kinds}, diff long")).collect():
            total[as_key(r)] += r.diff
        for *key, n in changes:
            live[tuple(key)] += n
        rows = spark.createDataFrame([k for k, c in live.items() for _ in range(c)], kinds)
        want = collections.Counter(as_key(r) for r in MultiColumnEncoder(config()).fit(rows).columns(rows, names).collect())
        assert by_place({k: c for k, c in total.items() if c}) == by_place(want)


def test_sparse_vectors_are_the_dense_ones(spark, monkeypatch):
    from featureflow.operators import text

    df = spark.createDataFrame([(1, "a b a c"), (2, None), (3, ""), (4, "zz a  unknown"), (5, "b"), (5, "b")], "id long, t string")
    fit = df.filter("id <> 4").unionByName(spark.createDataFrame([(9, "zz d e f")], "id long, t string"))

    def vectors(binary):
        p = Pipeline([CountVectorizer(binary), TfidfTransformer()]).fit(fit, "t")
        counts = p.encoders[0].transform(df, "t", "c").select("id", "c")
        return [sorted(((r[0], r[1]) for r in x.collect()), key=str) for x in (counts, p.transform(df, "t", "v").select("id", "v"))]

    for binary in (False, True):
        monkeypatch.setattr(text, "DENSE", 1000)
        dense = vectors(binary)
        monkeypatch.setattr(text, "DENSE", 2)
        sparse = vectors(binary)
        for a, b in zip(dense, sparse, strict=True):
            opened = []
            for i, v in b:
                full = [0.0] * v.size
                for k, x in zip(v.indices, v["values"], strict=True):
                    full[k] = x
                opened.append((i, full))
            assert sorted(opened, key=str) == a


WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def test_sparse_tfidf_against_brute_force(spark, monkeypatch):
    """Common, rare, long and unknown tokens, all white space, letters that share its bytes; rows are written once at most."""
    from featureflow.functions import storage, vectors
    from featureflow.operators import text

    near = "\u00a1\u0084\u1681\u200b\u2027\u2030\u2060\u3001\u180e"
    texts = ["a b a c", None, "", " \t\n", "b", "b", "".join(chr(w) + t for w, t in zip(WHITE, "bcdefghijklmnopqrstuvwxyzé", strict=False)), "x" * 200 + " a " + "x" * 200, f"{near} a{near}a", "zwölf 語 語\u3000語 a"]
    df = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "id long, t string").repartition(3)
    more = df.unionByName(spark.createDataFrame([(50, "a unknown b")], "id long, t string"))
    split = lambda t: [w for w in re.split("[" + "".join(map(chr, WHITE)) + "]+", t or "") if w]
    known = sorted({w for t in texts for w in split(t)}, key=lambda w: w.encode())
    weight = {w: math.log(len(texts) / (len(texts) - sum(w in split(t) for t in texts))) for w in known}
    want = lambda binary: sorted((i, [(known.index(w), round((1 if binary else split(t).count(w)) * weight[w], 12)) for w in known if w in split(t)]) for i, t in [*((i % 9, t) for i, t in enumerate(texts)), (50, "a unknown b")])
    names = []

    def noted(table, name):
        names.append(name)
        return storage.written(table, name)

    for module in (text, vectors):
        monkeypatch.setattr(module, "written", noted)
    monkeypatch.setattr(text, "DENSE", 2)
    for binary, head in ((False, 500_000), (False, 3), (True, 1), (False, 0)):
        names.clear()
        monkeypatch.setattr(text, "HEAD", head, raising=False)
        out = Pipeline([CountVectorizer(binary), TfidfTransformer()]).fit(df, "t").transform(more, "t", "v").collect()
        assert sorted((r.id, [(p, round(x, 12)) for p, x in zip(r.v.indices, r.v["values"], strict=True)]) for r in out) == want(binary)
        assert names.count("rows") <= 1


def test_slices_of_texts(monkeypatch):
    """Batches taken in slices of a row, and parts of larger arrays, give what they give at once."""
    from featureflow.functions import counting

    texts = pa.array(["skipped", "a b a c", None, "", "zz a", "\u3000é é\u2003", "a " * 40])[1:]
    run = lambda: [counting.packed(pa.array(["a", "é"]))(texts), counting.packed(pa.array([], pa.string()))(texts[:0])]

    def fill(parts):
        rest = pa.array([None, [{"to": 1, "n": 2, "w": 0.5}], [], None, [{"to": 9, "n": 1, "w": 2.0}, {"to": 1, "n": 3, "w": 1.0}], None])
        rest = rest.cast(pa.list_(pa.struct([("to", pa.int32()), ("n", pa.int32()), ("w", pa.float64())])))
        return counting.filled(np.array([0, 5]), np.array([1.0, 3.0]), False)(parts.field("at"), parts.field("n"), rest).to_pylist()

    def have():
        found = collections.Counter()
        for b in counting.frequencies(iter([pa.RecordBatch.from_arrays([texts], ["value"])])):
            for r in b.to_pylist():
                found[r["value"]] += r["have"]
        return found

    whole, filled, all_have = run(), fill(run()[0]), have()
    assert all_have == {"a": 3, "b": 1, "c": 1, "zz": 1, "é": 1}
    assert [r["rest"] for r in whole[0].to_pylist()] == [[{"k": "b", "n": 1}, {"k": "c", "n": 1}], [], [], [{"k": "zz", "n": 1}], [], []]
    assert filled == [{"indices": i, "values": v} for i, v in [([0], [2]), ([1], [1]), ([], []), ([0], [1]), ([1, 5, 9], [3, 6, 2]), ([0], [40])]]
    monkeypatch.setattr(counting, "SLICE_BYTES", 1)
    monkeypatch.setattr(counting, "SLICE_ENTRIES", 1)
    assert [p.to_pylist() for p in run()] == [p.to_pylist() for p in whole] and fill(run()[0]) == filled and have() == all_have


def test_counts_after_which_tfidf_was_fitted_elsewhere(spark, monkeypatch):
    from featureflow.operators import text

    monkeypatch.setattr(text, "DENSE", 2)
    df = spark.createDataFrame([("a b c",), ("a",)], "t string")
    other = spark.createDataFrame([("a b c",), ("b c",), ("c",)], "t string")
    p = Pipeline([CountVectorizer(), TfidfTransformer()]).fit(df, "t")
    p.encoders[0].fit(other, "t")  # weights stay those of df
    assert sorted(r.v["values"] for r in p.transform(df, "t", "v").collect()) == [[0], [0, math.log(2), math.log(2)]]


def test_many_values_are_numbered_by_parts(spark):
    from featureflow.operators.categorical import numbered

    values = spark.range(500).selectExpr("cast(id * 7 % 500 AS string) AS value").repartition(4)
    want = {v: i for i, v in enumerate(sorted(str(i) for i in range(500)))}
    for one_task in (10, 1000):
        assert {r.value: r.pos for r in numbered(values, 500, one_task).collect()} == want


def test_row_by_row(spark, tmp_path):
    df = modulo_rows(spark, 20, [5, 7])
    total = collections.Counter()
    epochs = 0
    for out in ready.row_by_row(spark, df, "row_id", str(tmp_path), share=0.9):
        epochs += 1
        for r in out.collect():
            total[r.row_id, r.e0, r.e1] += r.diff
    want = {(r.row_id, r.e0, r.e1) for r in ready.scale_all(df.drop("row_id")).fit(df).columns(df, ["row_id"]).collect()}
    assert epochs == 3 and {k for k, n in total.items() if n} == want


def test_large_values_of_small_spread(spark, tmp_path):
    inc = IncrementalEncoder(spark, [("x", StandardScaler())], "id long, x double", str(tmp_path))
    total = collections.Counter()
    for epoch, (a, b, sign) in enumerate([(0, 4, 1), (4, 14, 1), (10, 14, -1)]):
        rows = spark.range(a, b).select("id", (F.col("id") + 1e9).alias("x"), F.lit(sign).alias("diff"))
        for r in inc.process(epoch, rows).collect():
            total[r.id, round(r.e0, 9)] += r.diff
    assert {k for k, n in total.items() if n} == {(i, round((i - 4.5) / 8.25, 9)) for i in range(10)}
    with pytest.raises(ValueError):
        inc.process(4, spark.range(0).selectExpr("id", "1d AS x", "1 AS diff"))
    with pytest.raises(ValueError):
        IncrementalEncoder(spark, [("e0", StandardScaler())], "e0 double", str(tmp_path))


def test_a_value_or_two_leave_the_others_alone(spark, tmp_path):
    """New values within a width, and values that go, put out their own rows only; a log of many parts stays short."""
    inc = IncrementalEncoder(spark, [("v", OneHotEncoder()), ("v", OrdinalEncoder())], "id long, v string", str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "id long, v string, diff long")
    assert inc.process(0, rows(*[(i, "abcdef"[i % 6], 1) for i in range(60)])).count() == 60  # six of eight places
    out = inc.process(1, rows((100, "x", 1), (101, "x", 1), (5, "f", -1))).collect()
    assert sorted((r.id, r.diff, r.e1) for r in out) == [(5, -1, 5.0), (100, 1, 6.0), (101, 1, 6.0)]
    gone = [(i, "f", -1) for i in range(11, 60, 6)]
    out = inc.process(2, rows(*gone)).collect()
    assert {(r.v, r.diff, r.e1) for r in out} == {("f", -1, 5.0)} and len(out) == 9
    out = inc.process(3, rows((102, "y", 1), (103, None, 1))).collect()
    assert sorted((r.id, r.e1) for r in out) == [(102, 5.0), (103, -1.0)]  # the free place
    for epoch in range(4, 16):
        inc.process(epoch, rows((1000 + epoch, "a", 1))).collect()
    state = inc._load(15)
    assert len(state.rows) <= 9
    assert inc._read(state.rows).agg(F.sum("diff")).first()[0] == 60 + 2 - 10 + 2 + 12


def test_rounded_metadata_keep_updates_small(spark, tmp_path):
    inc = IncrementalEncoder(spark, [("x", StandardScaler(1, 1))], "id long, x double", str(tmp_path))
    base = spark.range(100).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit(1).alias("diff"))
    assert inc.process(0, base).count() == 100
    assert inc.process(1, base.limit(1).withColumn("id", F.lit(1000).cast("long"))).count() == 1
    again = inc.process(1, base.limit(1).withColumn("id", F.lit(1000).cast("long"))).collect()
    assert len(again) == 1  # an epoch that is repeated gives the same


def test_streaming_equals_batch(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select("id", (F.col("id") * 1.5).alias("x"), F.lit(1).alias("diff")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("id long, x double, diff int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    inc = IncrementalEncoder(spark, [("x", MinMaxScaler())], "id long, x double", f"{tmp_path}/state")
    total = collections.Counter()

    def sink(out, epoch):
        for r in out.collect():
            total[r.id, r.e0] += r.diff

    inc.stream(source, sink, f"{tmp_path}/checkpoint").awaitTermination()
    assert {k for k, c in total.items() if c} == {(i, i * 1.5 / 43.5) for i in range(30)}
