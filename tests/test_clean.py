import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.columns import normalise
from tabloom.functions.numbers import parse_number, strip_number_format
from tabloom.functions.records import human_size
from tabloom.operators import clean, detect, encode, impute, quantiles, scale, split
from tabloom.operators.clean import COPIES, ROW_KEY


def test_parse_number_agrees_with_pandas(spark):
    cells = ["1_000", "0x10", "inf", "-Infinity", "nan", "1e5", " 5 ", ".5", "5.", "+3", "True", "", "1d", "1.5f", "1 2",
             "1E+3", "--1", "infinity", "1e400", "\t7\n", "-0.25", "e5", ".", "+"]
    df = spark.createDataFrame(list(enumerate(cells)), "i long, s string")
    got = [r[0] for r in df.orderBy("i").select(parse_number(F.col("s"))).collect()]
    want = pd.to_numeric(pd.Series(cells), errors="coerce").astype(float)
    assert [None if np.isnan(w) else w for w in want] == got


def test_formatted_number_agrees_with_pandas(spark):
    cells = ["$1,200", " $ 30 ", "%5", "1,2,3", "5 %", "-$4", "$-4", "inf%", "abc", "$", "", "I", "12abc", "1e3$", ",,7"]
    df = spark.createDataFrame(list(enumerate(cells)), "i long, s string")
    got = [r[0] for r in df.orderBy("i").select(parse_number(strip_number_format(F.col("s")))).collect()]
    bare = pd.Series(cells).str.replace("[$%,]", "", regex=True).str.strip()
    want = pd.to_numeric(bare, errors="coerce").astype(float)
    assert [None if np.isnan(w) else w for w in want] == got


def test_human_size_rounds_half_even(spark):
    sizes = [0, 1023, 1024, 1280, 1331, 1048575, 1048576, 1310720, 5 * 1024**3]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
    got = [r[0] for r in df.orderBy("i").select(human_size(F.col("n"))).collect()]

    assert got == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.3 KB", "1024.0 KB", "1.0 MB", "1.2 MB", "5120.0 MB"]


def test_normalise_makes_nan_null(spark):
    df = normalise(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, n int"))
    assert df.where("x IS NULL").count() == 1 and dict(df.dtypes) == {"x": "double", "n": "bigint"}
    with pytest.raises(ValueError):
        normalise(spark.createDataFrame([([1],)], "a array<int>"))


def test_duplicates_count_nulls_as_equal(spark):
    rows = [(1, "a", None), (1, "a", None), (1, "a", ""), (2, None, "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "n long, s string, t string")
    out = clean.distinct_rows(df).collect()
    assert sorted(r[COPIES] for r in out) == [1, 2, 2]
    assert len({r[ROW_KEY] for r in out}) == 3
    assert tuple(clean.duplicate_report(df).first()) == (5, 3, 2)


def test_key_is_the_smallest_among_copies(spark):
    df = spark.createDataFrame([(10, 1, "a"), (9, 2, "a"), (3, 1, "b")], "k long, j long, s string")
    one = {r["s"]: r[ROW_KEY] for r in clean.distinct_rows(df.drop("j"), ["k"], ["k"]).collect()}
    two = {r["s"]: r[ROW_KEY] for r in clean.distinct_rows(df, ["k", "j"], ["k", "j"]).collect()}
    assert one == {"a": "9", "b": "3"} and two == {"a": "9|2", "b": "3|1"}
    part = {r["s"]: r[ROW_KEY] for r in clean.distinct_rows(df.withColumn("j", F.lit(7)), ["k", "j"], ["k"]).collect()}
    assert part == {"a": "9|7", "b": "3|7"}


def test_key_is_compared_unless_ignored(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a")], "k long, s string")
    assert sorted((r[ROW_KEY], r[COPIES]) for r in clean.distinct_rows(df, ["k"]).collect()) == [("1", 1), ("2", 2)]


def test_number_formats(spark):
    rows = [("$1,200", "12%", "a", None), (" $30 ", "7.5 %", "1", "1"), ("$5", "", "2", "2"), ("$7", "3", "3", "3"),
            ("$8", "4", "4", "4"), ("9", "5", "5", "5")]
    df = spark.createDataFrame(rows, "price string, share string, mixed string, gap string")
    out, types = clean.clean_number_formats(df)
    assert types == {"price": "long", "share": "double", "mixed": "double", "gap": "double"}
    assert [r[0] for r in out.orderBy("price").select("price").collect()] == [5, 7, 8, 9, 30, 1200]
    same, types = clean.clean_number_formats(spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("x",)], "s string"))
    assert types == {} and dict(same.dtypes) == {"s": "string"}


@pytest.mark.parametrize("schema, values, want", [
    ("y string", ["red", "green", "red", "blue"], "classification"),
    ("y double", [0.5, 9.25, -4.75, 2.125], "regression"),
    ("y long", [0, 1, 1, 0], "classification"),
    ("y long", [0, 1, None, 0], "regression"),
    ("y long", list(range(11)), "regression"),
    ("y long", list(range(10)) * 3, "classification"),
    ("y boolean", [True, False, True], "regression"),
    ("y boolean", [True, None, True], "classification"),
    ("y double", [None, None], "classification"),
])
def test_problem_type(spark, schema, values, want):
    df = spark.createDataFrame([(v,) for v in values], schema)
    assert detect.detect_problem_type(df, "y") == want
    assert detect.problem_types(df, ["y"]).first()["problem_type"] == want


def test_problem_type_without_target(spark):
    assert detect.detect_problem_type(spark.range(3), None) == "classification"


@pytest.mark.parametrize("n, hot", [(4001, 0), (4000, 0), (5000, 1700), (3000, 2900)])
def test_bracketed_median_is_exact(spark, n, hot):
    rng = np.random.default_rng(n + hot)
    a = rng.lognormal(0, 4, n)
    a[:hot] = 3.0
    b = rng.integers(-5, 6, n).astype(float)
    pdf = pd.DataFrame({"a": a, "b": b, "c": np.where(rng.random(n) < 0.3, np.nan, a)})
    df = normalise(spark.createDataFrame(pdf).repartition(5))
    got = quantiles.exact_medians(df, ["a", "b", "c"])
    for name in pdf:
        assert got[name] == pytest.approx(pdf[name].median(), rel=1e-12)


def test_median_of_a_heavy_tie_ends(spark):
    zeros = spark.range(40_003).select(F.lit(0.0).alias("x"))
    rest = spark.range(39_997).select((F.col("id") + 1.5).alias("x"))
    assert quantiles.exact_medians(zeros.unionByName(rest), ["x"]) == {"x": 0.0}
    even = spark.range(40_000).select(F.lit(0).cast("long").alias("x")).unionByName(
        spark.range(40_000).select((F.col("id") + (1 << 60)).alias("x")))
    assert quantiles.exact_medians(even, ["x"]) == {"x": (1 << 60) / 2}


def test_fills_agree_with_pandas(spark):
    pdf = pd.DataFrame({
        "n": [1.0, None, 4.0, 10.0, 2.0], "s": ["b", "a", None, "a", "b"], "wide": [None, None, None, 1.0, 2.0],
        "full": [1, 2, 3, 4, 5], "half": [None, None, 1.0, 2.0, 3.0]})
    df = normalise(spark.createDataFrame(pdf, "n double, s string, wide double, full long, half double"))
    fills = impute.fit_fills(df, df.columns)
    assert fills.dropped == {"wide": 60.0}
    assert fills.values == {"n": 3.0, "s": "a", "half": 2.0}
    assert impute.fit_fills(df, df.columns, "median").values["wide"] == 1.5
    assert set(impute.fit_fills(df, df.columns, "drop").dropped) == {"n", "s", "wide", "half"}
    assert impute.apply_fills(df, fills).where("n IS NULL OR s IS NULL OR half IS NULL").count() == 0
    with pytest.raises(ValueError):
        impute.fit_fills(df, df.columns, "guess")


def test_levels(spark):
    rows = [(str(i % 20), str(i % 15), "yn"[i % 2], "only") for i in range(60)]
    df = spark.createDataFrame(rows, "wide string, many string, two string, one string")
    levels = encode.fit_levels(df)
    assert levels.dropped == ["wide"] and levels.onehot() == ["many"] and levels.binary() == ["two", "one"]
    out = encode.apply_levels(df, levels)
    assert out.columns == ["two", "one"] + [f"many_{v}" for v in sorted(map(str, range(15)))]
    total = sum((F.col(n) for n in out.columns[2:]), F.lit(0))
    assert out.select(total.alias("t")).distinct().collect() == [(1,)]
    assert out.agg(F.max("one"), F.sum("two")).first() == (0, 30)


def test_indicator_names_do_not_collide(spark):
    rows = [("b_c", "x"), ("q", "c"), ("r", "y"), ("b_c", "z")]
    df = spark.createDataFrame(rows, "a string, a_b string")
    names = encode.apply_levels(df, encode.fit_levels(df)).columns
    assert len(set(names)) == len(names) == 7


def test_class_table_both_ways(spark):
    df = spark.createDataFrame([(f"c{i % 137:03d}",) for i in range(1000)], "y string").repartition(6)
    few, labels = encode.class_table(df, "y")
    many, none = encode.class_table(df, "y", small=10)
    assert none is None and labels == sorted(labels) and len(labels) == 137
    assert sorted(few.collect()) == sorted(many.collect())


def test_scaler(spark):
    df = spark.createDataFrame([(float(i), 5.0, i) for i in range(10)], "x double, same double, n long")
    out = scale.apply_scaler(df, scale.fit_scaler(df))
    row = out.agg(F.avg("x"), F.stddev_pop("x"), F.max("same"), F.stddev_pop("n")).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(1) and row[2] == 0 and row[3] == pytest.approx(1)


@pytest.mark.parametrize("n, share", [(3, 0.2), (10, 0.25), (997, 0.1), (20_000, 0.35)])
def test_split_is_exact_and_stable(spark, n, share):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"))
    one = split.split_exact(df, F.col("k"), share)
    two = split.split_exact(df.repartition(7), F.col("k"), share)
    test_rows = {r["k"] for r in one.where("split = 'test'").collect()}
    assert len(test_rows) == int(np.ceil(n * share)) and one.count() == n
    assert test_rows == {r["k"] for r in two.where("split = 'test'").collect()}


def test_split_narrows_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(split, "SMALL_BUCKET", 0)
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    assert split.split_exact(df, F.col("k"), 0.3).where("split = 'test'").count() == 1500


def test_split_refuses_repeated_keys(spark):
    df = spark.createDataFrame([("a",)] * 10, "k string")
    with pytest.raises(ValueError):
        split.split_exact(df, F.col("k"), 0.3)
