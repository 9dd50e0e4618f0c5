from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import loomframe as lf
from loomframe.config import load, parse
from loomframe.errors import CardinalityError, LoomError
from loomframe.operators import columns as cols
from loomframe.operators import diff as d
from loomframe.operators import encode, impute, lineage
from loomframe.operators.positions import place
from loomframe.sources import synthetic as made
from loomframe.sources.frames import as_frame, as_type
from loomframe.streaming import stateless


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


# ---- lookup


@pytest.fixture(scope="module")
def target(spark):
    return frame(spark, "id int, value int", (1, 10), (2, 20), (3, 30))


@pytest.fixture(scope="module")
def many(spark):
    return frame(spark, "id int, n int, s string, at int", (1, 5, "b", 1), (1, 7, "a", 2), (2, None, " c ", 1), (2, 1, "dd", 2))


def test_lookup_renames_and_places(spark, target):
    ref = frame(spark, "id int, full_name string, other int", (1, "A", 0), (2, "B", 0), (9, "C", 0))
    out = lf.to(target, ref, [("full_name", "name")], "id", "after:id")
    assert out.columns == ["id", "name", "value"]
    assert sorted(values(out, "id", "name")) == [(1, "A"), (2, "B"), (3, None)]


@pytest.mark.parametrize(
    ("mode", "column", "wanted"),
    [
        ("first", "n", [5, None, None]), ("last", "n", [7, 1, None]), ("sum", "n", [12, 1, None]), ("count", "n", [2, 2, None]), ("mean", "n", [6, 1, None]), ("forward_fill", "n", [5, 1, None]),
        ("first:trim", "s", ["b", "c", None]), ("concat[, ]", "s", ["b, a", " c , dd", None]), ("concat[\\n]", "s", ["b\na", " c \ndd", None]), ("concat", "n", ["5|7", "|1", None]), ("shortest", "s", ["b", "dd", None]),
        ("longest", "s", ["b", " c ", None]), ("most_common", "s", ["a", " c ", None]), ("unique_count", "n", [2, 1, None]), ("list", "at", [[1, 2], [1, 2], None]), ("least_common", "s", ["a", " c ", None]),
    ],
)
def test_lookup_modes(target, many, mode, column, wanted):
    out = lf.to(target, many, [(column, "x")], "id", strategy={column: mode}, order_by="at")
    assert values(out.orderBy("id"), "x") == wanted


def test_lookup_keeps_rows_and_guards(spark, target, many):
    with pytest.raises(Exception, match="different values"):
        lf.to(target, many, "s", "id").collect()
    with pytest.raises(Exception, match="several rows"):
        lf.to(target, many, "s", "id", strategy={"s": "strict"}).collect()
    twice = target.unionByName(target)
    with pytest.raises(CardinalityError, match="many:many"):
        lf.to(twice, many, "n", "id")
    assert lf.to(twice, many, "n", "id", strategy={"n": "sum"}).count() == 6
    assert lf.to(twice, many.where("at = 1"), "s", "id").count() == 6
    for how in ("left", "inner", "outer", "right"):
        with pytest.raises(CardinalityError, match="1:many"):
            lf.to(target, many, "n", "id", join_type=how)
    with pytest.raises(LoomError, match="valu"):
        lf.to(target, many, "valu", "id")
    with pytest.raises(LoomError, match="numbers"):
        lf.to(target, many, "s", "id", strategy={"s": "sum"})
    nulls = frame(spark, "id int, value int", (None, 1), (1, 2))
    assert sorted(values(lf.to(nulls, many.where("at = 1"), "s", "id"), "value", "s")) == [(1, None), (2, "b")]


def test_many_frames(spark, target, many):
    both = lf.to([target, target.where("id = 1")], [many.where("at = 1"), many.where("id = 3")], "s", "id")
    assert [f.count() for f in both] == [3, 1]
    assert lf.to("@new", many, ["n"], "id").columns == ["id", "n"]
    with pytest.raises(LoomError, match="different columns"):
        lf.to(target, [many, many.drop("at")], "s", "id")


def test_merge(spark, target):
    name = frame(spark, "id int, name string", (1, "x"), (2, "y"), (3, "z"))
    assert lf.merge([target, target], "v").count() == 6
    assert lf.merge([target, name], "h", by="id").columns == ["id", "value", "name"]
    assert lf.merge([target, name], "d").count() == 6
    for bad in ({"frames": [target]}, {"frames": [target, name]}, {"frames": [target, name], "how": "h"}, {"frames": [target, name], "how": "x"}):
        with pytest.raises(LoomError):
            lf.merge(**bad)


def test_positions(spark):
    df = frame(spark, "a int, b int, c int, new int", (1, 2, 3, 4))
    assert place(df, ["new"], "start").columns[0] == "new"
    assert place(df, ["new"], "end").columns[-1] == "new"
    assert place(df, ["new"], "after:a").columns == place(df, ["new"], 1).columns == ["a", "new", "b", "c"]
    assert place(df, ["new"], "before:c").columns == ["a", "b", "new", "c"]
    assert place(df, ["new"], -1).columns[-1] == "new"
    for bad in (10, -9, "near:a", "after:zz", True):
        with pytest.raises(LoomError):
            place(df, ["new"], bad)


# ---- transforms


def test_rounding(spark):
    df = frame(spark, "x double", (2.5,), (3.5,), (-2.5,), (2.1,), (None,))
    assert values(lf.transform("@round:0", df, "x"), "x_round") == [3, 4, -2, 2, None]
    assert values(lf.transform("@bankers_round", df, "x", strategy={"decimals": 0}), "x_round") == [2, 4, -2, 2, None]
    assert values(lf.transform("@roundup:0", df, "x"), "x_round") == [3, 4, -2, 3, None]
    assert values(lf.transform("@rounddown:0", df, "x", strategy={"x": "low"}), "low") == [2, 3, -3, 2, None]
    with pytest.raises(LoomError, match="numeric"):
        lf.transform("@round", frame(spark, "s string", ("a",)), "s")


def test_filter_sort_split(spark):
    df = frame(spark, "name string, age int", ("Alice Smith", 25), ("Bob", 30), ("Charlie B Brown", None))
    assert values(lf.transform("@filter", df, ["name"], where="age >= 25 and age <= 29"), "name") == ["Alice Smith"]
    assert values(lf.transform("@sort", df, by="age", order="desc"), "age") == [None, 30, 25]
    assert values(lf.transform("@sort", df, by="age", strategy="desc"), "age") == [None, 30, 25]
    assert values(lf.transform("@split", df, "name"), "name_1", "name_2") == [("Alice", "Smith"), ("Bob", None), ("Charlie", "B")]
    with pytest.raises(LoomError):
        lf.transform("@sort", df, by="age", order="up")
    with pytest.raises(LoomError, match="mode"):
        lf.transform("@nosuch", df)


def test_rows(spark):
    df = spark.range(10)
    assert values(cols.rows(df, "last:2", "id"), "id") == [9, 8]
    assert values(cols.rows(df, "3-4", "id"), "id") == [2, 3]
    assert values(cols.rows(df, "10", "id"), "id") == [9]
    with pytest.raises(LoomError):
        cols.rows(df, "x", "id")


def test_extract(spark):
    df = frame(spark, "mail string, at string, n int", ("a@b.com", "2024-02-20 13:05:00", 1), (None, "bad", 2))
    assert values(lf.transform("@extract", df, "mail"), "mail_username", "mail_domain") == [("a", "b.com"), (None, None)]
    assert values(lf.transform("@datetime", df, "at"), "at_hour", "at_month") == [(13, 2), (None, None)]
    with pytest.raises(LoomError, match="datetime or string"):
        lf.transform("@extract", df, "n")
    days = spark.sql("SELECT date'2024-01-15' AS d")
    assert lf.transform("@extract", days, "d").columns == ["d", "d_year", "d_month", "d_day"]
    mid = cols.to_datetime(frame(spark, "d string", ("2024-03",), ("2024",), ("2024-05-06",), ("x",)), "d", "mid")
    assert [str(v)[:10] for v in values(mid, "d")] == ["2024-03-15", "2024-07-01", "2024-05-06", "None"]


def test_units(spark):
    df = frame(spark, "x double", (0.0,), (1.0,))
    go = lambda **s: [round(v, 4) for v in values(lf.transform("@harmonize", df, strategy={"x": {"name": "y", **s}}), "y")]
    assert go(kind="temperature", **{"from": "c", "to": "f"}) == [32, 33.8]
    assert go(kind="temperature", **{"from": "c", "to": "k"}) == [273.15, 274.15]
    assert go(kind="weight", **{"from": "kg", "to": "lb"})[1] == pytest.approx(2.2046, abs=1e-3)
    assert go(kind="distance", **{"from": "km", "to": "mile"})[1] == pytest.approx(0.6214, abs=1e-3)
    with pytest.raises(LoomError):
        go(kind="weight", **{"from": "kg", "to": "parsec"})
    with pytest.raises(LoomError):
        go(kind="currency")


def test_encoding(spark):
    df = frame(spark, "id int, c string, g int", (1, "A", 10), (2, "B", 9), (3, None, 10), (4, "C", 2))
    out = encode.onehot(df, "c", drop_first=True)
    assert out.columns[-2:] == ["c_B", "c_C"]
    assert values(out.orderBy("id"), "c_B", "c_C") == [(0, 0), (1, 0), (0, 0), (0, 1)]
    assert encode.onehot(df.withColumnRenamed("c", "kind"), "kind", prefix=False).columns[-3:] == ["A", "B", "C"]
    with pytest.raises(LoomError, match="already"):
        encode.onehot(df, "c", prefix=False)
    assert values(encode.label(df, ["c", "g"]).orderBy("id"), "c_code", "g_code") == [(0, 0), (1, 2), (None, 0), (2, 1)]
    flat = encode.transpose(frame(spark, "A int, B int", (1, 4), (2, 5), (3, 6)).coalesce(1))
    assert flat.count() == 2 and len(flat.columns) == 4
    with pytest.raises(LoomError):
        encode.transpose(spark.range(20), most=10)
    with pytest.raises(LoomError):
        encode.onehot(spark.range(20), "id", most=10)


# ---- imputation


def test_fill(spark):
    df = frame(spark, "i int, a int, s string", (1, 1, "x"), (2, None, None), (3, 3, "y"), (4, None, "y"), (5, 5, None))
    at = lambda m, c="a", **o: values(impute.deduce(df, c, m, order_by="i", **o).orderBy("i"), f"{c}_infer")
    assert at("ffill") == [1, 1, 3, 3, 5]
    assert at("bfill") == [1, 3, 3, 5, 5]
    assert at("interpolate") == [1, 2, 3, 4, 5]
    assert at("mean") == at("median") == at("auto") == [1, 3, 3, 3, 5]
    assert at("auto", "s") == ["x", "y", "y", "y", "y"]
    assert impute.deduce(df.withColumn("a_infer", F.lit(0)), "a", "mean").columns[-1] == "a_infer_01"
    with pytest.raises(LoomError):
        impute.deduce(df, "a", "ffill")
    with pytest.raises(LoomError):
        impute.deduce(df, "a", "magic")


def test_fill_many_ranges(spark):
    df = spark.range(5000).withColumn("v", F.when(F.col("id") % 700 == 3, F.col("id")))
    got = values(impute.deduce(df, "v", "ffill", order_by="id").orderBy("id"), "v_infer")
    assert got == [None if i < 3 else (i - 3) // 700 * 700 + 3 for i in range(5000)]


def test_knn(spark):
    df = frame(spark, "i int, a double, b double", (1, 1.0, 5.0), (2, None, 6.0), (3, 3.0, None), (4, 4.0, 8.0))
    out = lf.transform("@knn", df, ["a", "b"], strategy={"k": 3}, order_by="i").orderBy("i").collect()
    assert out[1].a == pytest.approx(8 / 3) and out[2].b == pytest.approx(19 / 3)
    near = impute.knn(df, ["a"], k=1, order_by="i").orderBy("i").collect()
    assert near[1].a_infer == 3.0  # the third row shares no feature with it: distance 0
    for bad in ({"k": 4}, {"k": 0}, {"metric": "x"}):
        with pytest.raises(LoomError):
            impute.knn(df, ["a"], order_by="i", **bad)
    with pytest.raises(LoomError):
        impute.knn(df.withColumn("n", F.lit(None).cast("double")), ["n"], k=1, order_by="i")


def test_knn_of_many_ties_takes_little(spark):
    """All distances are 0: one block held 5,000 x 2,000 rows of pairs."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n = 4000
    asked = pd.DataFrame({"id": np.arange(n), "f0": np.full(n, np.nan)})
    rows = pd.DataFrame({"id": np.arange(n)[::-1].astype(float), "f0": np.full(n, np.nan), "v": np.arange(n)[::-1].astype(float)})
    tracemalloc.start()
    out = impute._nearest("euclidean", 3, ["f0"])(asked, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 3 * n and set(out["r"]) == {0.0, 1.0, 2.0} and peak < 60_000_000


def test_knn_against_brute_force(spark):
    """Few and many different vectors, gaps in features, NaN, and blocks smaller than the table."""
    import math
    import random

    draw = random.Random(5)
    feature = lambda wide: draw.choice([None, math.nan, -0.0, 0.0, 1.0, 2.0]) if not wide else draw.uniform(0, 9)
    for wide, metric, weights in ((False, "euclidean", "uniform"), (True, "euclidean", "distance"), (False, "manhattan", "distance")):
        data = [(i, feature(wide), feature(wide), None if i % 3 == 0 else math.nan if i % 17 == 1 else draw.uniform(-5, 5)) for i in range(150)]
        df = spark.createDataFrame(data, "i int, x double, y double, v double")
        got = {r.i: r.v_infer for r in impute.knn(df, ["v"], k=4, metric=metric, weights=weights, order_by="i", block=4).collect()}
        for i, *f, v in data:
            if v is not None:
                continue
            near = []
            for j, *g, w in data:
                gaps = [abs(a - b) for a, b in zip(f, g, strict=True) if a is not None and b is not None and not math.isnan(a) and not math.isnan(b)]
                near += [(sum(gaps) if metric == "manhattan" else math.sqrt(sum(a * a for a in gaps)), j, w)] if j != i else []
            used = [(d, w) for d, _, w in sorted(near, key=lambda x: x[:2])[:4] if w is not None and not math.isnan(w)]
            weigh = [1.0 if weights == "uniform" else 1 / (d + 1e-10) for d, _ in used]
            want = sum(a * w for a, (_, w) in zip(weigh, used, strict=True)) / sum(weigh) if used else None
            assert (got[i] is None) == (want is None) and (want is None or math.isclose(got[i], want, rel_tol=1e-9)), (i, got[i], want)


def test_knn_asks_for_each_vector_once(spark, monkeypatch):
    """The blocks get different vectors and a few rows of each, not rows x gaps."""
    sizes = []
    cells = impute._cells
    monkeypatch.setattr(impute, "_cells", lambda a, n, b, m, *rest: sizes.append((a.count(), b.count())) or cells(a, n, b, m, *rest))
    df = spark.range(2000).selectExpr("id", "id % 5 AS x", "CASE WHEN id % 7 <> 0 THEN id END AS v")
    assert impute.knn(df, ["v"], k=3, order_by="id").count() == 2000 and sizes == [(5, 20)]


def test_tfidf(spark):
    df = frame(spark, "i int, t string, l string", (1, "red apple fruit", "f"), (2, "fast blue car", "c"), (3, "green apple tree", "f"), (4, "apple fruit pie", None), (5, "the of", None))
    out = impute.tfidf(df, "l", ["t"], "g", order_by="i").orderBy("i").collect()
    assert [r.g for r in out] == ["f", "c", "f", "f", "f"]
    with pytest.raises(LoomError, match="3 labelled"):
        impute.tfidf(df.where("i > 2"), "l", ["t"], "g", order_by="i")


# ---- comparison


def test_diff(spark):
    old, new = frame(spark, "id int, val string", (1, "a"), (2, "b"), (3, "c")), frame(spark, "id int, val string", (1, "a"), (2, "x"), (4, "d"))
    out = lf.scan("@diff", old=old, new=new, key="id")
    assert sorted(values(out, "id", "val", "_diff_status")) == [("1", "a", "no_change"), ("2", "b → x", "changed"), ("3", "c", "deleted"), ("4", "d", "new")]
    assert values(d.ordered(out), "_diff_status") == ["new", "deleted", "changed", "no_change"]
    assert {r._diff_status for r in lf.scan("@diff", old=old, new=old).collect()} == {"no_change"}
    nulls = frame(spark, "id int, val string", (None, "a"), (2, None))
    assert sorted(values(lf.scan("@diff", old=nulls, new=nulls, key="id"), "_diff_status")) == ["deleted", "new", "no_change"]
    wide = frame(spark, "k1 int, k2 string, a int, b int, c int", (1, "a", 1, 1, 7))
    out = lf.scan("@diff", old=wide, new=wide.withColumn("a", F.lit(2)).withColumn("b", F.lit(3)), key="k1, k2", strategy={"output": "detail", "context": ["c"]})
    assert sorted(values(out, "_key", "_column", "_old_value", "_new_value", "c")) == [("1,a", "a", "1", "2", 7), ("1,a", "b", "1", "3", 7)]


def test_diff_options(spark):
    a = frame(spark, "id int, val string, ts int", (1, "a", 1))
    b = frame(spark, "id int, val string, ts int", (1, "a", 2))
    assert values(lf.scan("@diff", old=a, new=b, key="id", strategy={"exclude": "ts"}), "_diff_status") == ["no_change"]
    assert values(lf.scan("@diff", old=a, new=b, key="id", strategy={"carry": "ts"}), "ts", "_diff_status") == [("2", "no_change")]
    for bad in ({"exclude": "ts", "carry": "ts"}, {"nosuch": 1}, {"output": "x"}):
        with pytest.raises(LoomError):
            lf.scan("@diff", old=a, new=b, key="id", strategy=bad)
    two = frame(spark, "a int, b int, v int", (1, 1, 1), (1, 2, 1), (2, 1, 1))
    assert d.find_key(two, two) == ["a", "b"]
    with pytest.raises(LoomError):
        d.find_key(two.select("v"), two.select("v"))


# ---- profiles, synthetic data, lineage, settings, streams


def test_analyze(spark):
    df = frame(spark, "a int, s string", (1, "x"), (None, "x"), (3, None))
    got = {r["column"]: r for r in lf.analyze(df).collect()}
    assert (got["a"]["count"], got["a"]["null_count"], got["a"]["unique"], got["a"]["mean"]) == (3, 1, 3, 2.0)
    assert got["s"]["unique"] == 2 and got["s"]["mean"] is None
    assert lf.analyze(df, as_type="dict")["rows"] == 3 and "null" in lf.analyze(df, as_type="text")
    assert {r["column"] for r in lf.analyze(df, focus="nulls").collect()} == {"a", "s"}
    assert lf.analyze(df, rows="first:2", order_by="a", columns=["a"]).first()["count"] == 2


def test_synthetic(spark):
    spec = {
        "a": {"distribution": "lognormal", "mean": 1, "std": 0.5, "min": 1, "max": 4}, "b": {"distribution": "exponential", "lambda": 0.5}, "c": {"distribution": "binomial", "n": 10, "p": 0.5}, "u": {"pattern": "uuid"}, "e": {"pattern": "email", "domain": "t.com"},
        "r": {"pattern": "regex", "regex": "[A-Z]{3}-[0-9]{4}"}, "l": {"type": "linked_list", "levels": [["x", "y"], ["1", "2"]]}, "t": {"type": "time", "start": "09:00:00", "end": "17:00:00"}, "d": {"type": "datetime", "start": "2020-01-01 00:00:00", "end": "2020-01-02 00:00:00"},
    }
    one, other = (made.new(spark, 500, spec, partitions=p).toPandas() for p in (1, 7))
    assert sorted(one["u"]) == sorted(other["u"]) and one["u"].nunique() == 500
    assert one["a"].between(1, 4).all() and (one["b"] > 0).all() and one["c"].between(0, 10).all() and abs(one["c"].mean() - 5) < 0.4
    assert one["e"].str.match(r"^[a-z]{8}@t\.com$").all() and one["r"].str.match(r"^[A-Z]{3}-\d{4}$").all() and set(one["l"]) == {"x 1", "y 2"} and one["t"].between("09:00:00", "17:00:00").all()
    for bad in ({"x": "magic"}, {"x": {"distribution": "no"}}, {"x": {"type": "date", "start": "2020-01-02", "end": "2020-01-01"}}, {"x": {"values": ["a"], "weights": [1, 2]}}):
        with pytest.raises(LoomError):
            made.new(spark, 3, bad)
    small = frame(spark, "i int, s string", (1, "a"), (3, None))
    assert lf.synthetic(small, 5).count() == 7 and {r.s for r in lf.synthetic(small, 5).collect()} <= {"a", None}


def test_lineage_keeps_all_rows_of_large_groups(spark):
    df = spark.range(2500).select("id", (F.col("id") % 2).alias("g"))
    traced = lineage.Traced.start(df, "id").filter("id < 2400").aggregate("g", {"id": "sum"})
    assert sorted((r.g, r._row_id) for r in traced.row_map().collect()) == sorted((i % 2, i) for i in range(2400))
    assert sorted(r.id for r in traced.excluded().collect()) == list(range(2400, 2500))


def test_lineage(spark):
    df = frame(spark, "id int, v int, g string", (1, 1, "a"), (2, 2, "a"), (3, 3, "b"))
    ref = frame(spark, "id int, n string", (1, "x"))
    t = lf.Traced.start(df, "id").calc({"w": "v * 2"}).to(ref, "n", "id").filter("w > 2")
    assert values(t.excluded(), "id") == [1] and t.dependencies("w") == ["w", "v"] and t.sources["n"].kind == "brought"
    assert "1 rows removed WARNING" in lf.scan("@lineage", t)
    a = t.aggregate("g", {"w": "sum"})
    assert sorted(values(a.row_map(), "g", "_row_id")) == [("a", 1), ("b", 2)]
    assert values(lf.scan("@lineage", a, trace=[2]), "id") == [3]
    assert lineage.cycles({"a": ["b"], "b": ["a"]}) == ["a", "b", "a"] and not lineage.cycles({"a": ["b"]})
    assert isinstance(lf.transform("@calc", df, expression="v", lineage=True), lf.Traced)
    with pytest.raises(LoomError):
        lf.transform("@sort", df, by="v", lineage=True)


def test_frames_and_config(spark, tmp_path):
    pdf = spark.range(3).toPandas()
    assert as_frame(spark, pdf).count() == 3 and len(as_type(spark.range(2), "arrow")) == 2 and lf.transform("@calc", pdf, expression="id", as_type="pandas")["result"].tolist() == [0, 1, 2]
    with pytest.raises(LoomError):
        as_frame(spark, [1])
    (tmp_path / "config.toml").write_text('seed = 7\nlog_level = "warn"')
    assert (load(tmp_path, tmp_path / "none").seed, load(None, tmp_path / "none").seed) == (7, 42)
    for bad in ("x = 1", 'seed = "a"', 'log_level = "loud"'):
        with pytest.raises(LoomError):
            parse(bad)


def test_streams(spark, tmp_path, target):
    path = str(tmp_path / "in")
    target.write.parquet(path)
    stream = spark.readStream.schema(target.schema).parquet(path)
    ref = frame(spark, "id int, n string", (1, "x"), (2, "y"))
    out = stateless.enrich(stateless.apply(stateless.apply(stream, "calc", {"w": "value * 2"}), "filter", "w > 20"), ref, ["n"], "id")
    q = out.writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.table("seen"), "id", "w", "n"), key=str) == [(2, 40.0, "y"), (3, 60.0, None)]
    with pytest.raises(LoomError):
        stateless.apply(stream, "sort", "id")


def test_ranges_by_size(spark, monkeypatch):
    """What goes along an order gives the same in one range and in many."""
    import numpy as np
    import pandas as pd

    from loomframe.operators import impute

    rng = np.random.default_rng(0)
    v = pd.Series(np.where(rng.random(300) < 0.6, np.nan, rng.integers(0, 9, 300)))
    keys = rng.permutation(300)
    df = spark.createDataFrame([(int(k), None if np.isnan(v[k]) else float(v[k]), f"{k:03d}"[::-1]) for k in keys], "k int, v double, s string").repartition(3)
    wanted = {"forward": v.ffill(), "backward": v.bfill(), "interpolate": v.interpolate(limit_area="inside")}
    for rows in (10**6, 50, 4):
        monkeypatch.setattr(impute, "RANGE_ROWS", rows)
        for how, series in wanted.items():
            got = {r.k: r.v_infer for r in impute.deduce(df, "v", how, order_by="k").collect()}
            assert all((got[k] is None and np.isnan(series[k])) or got[k] == pytest.approx(series[k]) for k in range(300))
        assert sorted((r.s, r.i) for r in impute.numbered(df, "s", "i").collect()) == [(s, i) for i, s in enumerate(sorted(f"{k:03d}"[::-1] for k in range(300)))]
        assert all(r.s_code == r.i for r in lf.transform("@label", impute.numbered(df, ["s", "k"], "i"), "s").collect())


def test_backward_fill_of_one_large_group_is_no_square(spark):
    import time

    df = spark.range(80_000).select("id", F.lit(1).alias("g"), F.when(F.col("id") % 50_000 == 49_999, F.col("id").cast("double")).alias("v"))
    began = time.time()
    out = lf.transform("@deduce", df, infer="v", method="backward", order_by="id", by="g")
    assert out.where("v_infer IS NULL").count() == 30_000 and time.time() - began < 20


def test_settings(spark, tmp_path):
    from loomframe.plans import api

    (tmp_path / "config.toml").write_text(f'seed = 7\nas_type = "pandas"\nlog_level = "warn"\nformula_folder = "{tmp_path}"\n')
    (tmp_path / "own.add").write_text('[twice]\nexpression = "x * 2"\ndescription = "d"\ncategory = "c"\n\n')
    (tmp_path / "rules.add").write_text('[reconciliation]\nname = "lab"\n\n[aliases]\nalt = ["sgot", "ALAT"]\n\n[groups]\nliver = ["alt", "ast"]\n')
    before, folder = api._config, lf.formulas.folder
    try:
        assert lf.configure(str(tmp_path), str(tmp_path / "nowhere")).seed == 7
        one = lf.synthetic("@new", 20, strategy={"a": "normal(0, 1)"})
        assert type(one).__name__ == "DataFrame" and type(one).__module__.startswith("pandas")
        assert one["a"].tolist() == lf.synthetic("@new", 20, strategy={"a": "normal(0, 1)"}, seed=7)["a"].tolist() != lf.synthetic("@new", 20, strategy={"a": "normal(0, 1)"}, seed=8)["a"].tolist()
        assert lf.formulas.twice(frame(spark, "x int", (3,))).first().twice == 6
        old, new = frame(spark, "id int, SGOT string", (1, "a"), (2, "liver")), frame(spark, "id int, Alat string", (1, "b"), (2, "ast"))
        got = lf.scan("@diff", old=old, new=new, key="id", strategy={"aliases": "lab"})
        assert sorted(got["alt"]) == ["a → b", "liver → ast (hierarchy)"]
    finally:
        api._config, lf.formulas.folder = before, folder


def test_command_line(spark, tmp_path):
    from loomframe.__main__ import main

    frame(spark, "id int, v double", (1, 2.0), (2, 3.0)).coalesce(1).write.csv(str(tmp_path / "a.csv"), header=True)
    frame(spark, "id int, n string", (1, "x"), (2, "y")).write.parquet(str(tmp_path / "b.parquet"))
    at = lambda name: str(tmp_path / name)
    main(["transform", "@calc", at("a.csv"), "--out", at("c.json"), "--options", '{"expression": "v * 2", "name": "w"}'])
    assert values(spark.read.json(at("c.json")), "id", "w") == [(1, 4.0), (2, 6.0)]
    main(["to", at("a.csv"), at("b.parquet"), "--out", at("d"), "--options", '{"bring": "n", "against": "id"}'])
    assert values(spark.read.parquet(at("d")), "id", "n") == [(1, "x"), (2, "y")]
    main(["scan", "@diff", at("a.csv"), at("a.csv"), "--out", at("e.csv"), "--options", '{"key": "id"}'])
    assert {r._diff_status for r in spark.read.csv(at("e.csv"), header=True).collect()} == {"no_change"}
    main(["synthetic", "@new", "--out", at("f"), "--options", '{"n": 5, "strategy": {"a": "normal(0, 1)"}}'])
    assert spark.read.parquet(at("f")).count() == 5
    with pytest.raises(LoomError):
        main(["scan", "@diff", at("a.csv")])


def test_tfidf_meets_different_vectors(spark, monkeypatch):
    """Of labelled rows with the same text only the last meets the others; near ties are settled in double precision."""
    sizes = []
    cells = impute._cells
    monkeypatch.setattr(impute, "_cells", lambda a, n, b, m, *rest: sizes.append(b.count()) or cells(a, n, b, m, *rest))
    words = ("red apple pie", "green tea cup", "red tea", "blue sky")
    data = [(i, words[i % 4], None if i % 5 == 0 else f"l{i}") for i in range(80)] + [(80, "zzz", None), (81, None, None)]
    df = spark.createDataFrame(data, "i int, t string, l string")
    got = {r.i: r.g for r in impute.tfidf(df, "l", ["t"], "g", order_by="i").collect()}
    last = {w: f"l{max(i for i, t, label in data if t == w and label)}" for w in words}
    assert sizes == [4] and got == {i: label or last.get(t, "l79") for i, t, label in data}
