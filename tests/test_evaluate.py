import math

import pytest
from pyspark.sql import functions as F

from tabloom.operators import charts, evaluate, profile


def test_classification_metrics_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("c", "d")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    m = evaluate.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(3 / 6)
    assert m["precision"] == pytest.approx((2 * 0.5 + 2 * (2 / 3) + 2 * 0) / 6)
    assert m["recall"] == pytest.approx((2 * 0.5 + 2 * 1 + 0) / 6)
    assert m["f1"] == pytest.approx((2 * 0.5 + 2 * 0.8 + 0) / 6)


def test_regression_metrics_on_a_constant_label(spark):
    m = evaluate.regression_metrics(spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "label double, prediction double")).first()
    assert (m["mae"], m["mse"], m["r2"]) == (0.5, 0.5, 0.0) and m["rmse"] == pytest.approx(math.sqrt(0.5))
    m = evaluate.regression_metrics(spark.createDataFrame([(2.0, 2.0)], "label double, prediction double")).first()
    assert m["r2"] == 1.0


def test_best_model_ties_go_to_the_first_trained(spark):
    rows = [("z", 0, 0.9, 0.8), ("a", 1, 0.9, 0.8), ("b", 2, 0.95, 0.7)]
    metrics = spark.createDataFrame(rows, "model string, model_order long, accuracy double, f1 double")
    assert evaluate.select_best(metrics, "classification").first()["model"] == "z"
    rows = [("z", 0, 2.0, 0.8), ("a", 1, 1.0, 0.8), ("b", 2, 1.0, 0.9)]
    metrics = spark.createDataFrame(rows, "model string, model_order long, rmse double, r2 double")
    assert evaluate.select_best(metrics, "regression").first()["model"] == "b"
    assert [r["model"] for r in evaluate.leaderboard(metrics, "regression").collect()] == ["b", "a", "z"]


def test_correlation_forms_agree(spark):
    rows = [(float(i), float(i * i % 17), float(-i), 4.0) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double")
    by_blocks = {(r["a"], r["b"]): r["r"] for r in charts.correlation_matrix(df).collect()}
    every = [(a, b) for a in df.columns for b in df.columns]
    by_pairs = {(r["a"], r["b"]): r["r"] for r in charts.pair_correlations(df, every).collect()}
    assert by_pairs[("a", "c")] == pytest.approx(-1)
    for pair, r in by_pairs.items():
        assert (r is None) == (by_blocks[pair] is None)
        assert r is None or r == pytest.approx(by_blocks[pair])


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, None), (3.0, None, 1.0), (4.0, 4.0, 0.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in charts.correlation_matrix(df).collect()}
    want = df.toPandas().corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b])


def test_column_constant_over_the_pair_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 7.0), (2.0, None)], "a double, b double")
    assert {(r["a"], r["b"]): r["r"] for r in charts.correlation_matrix(df).collect()} == {
        ("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): None, ("b", "a"): None}


def test_wide_matrix_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), float(i * i % 11), None if i == 3 else float(i % 5)) for i in range(30)],
                               "a double, b double, c double")
    whole = sorted((r["a"], r["b"], round(r["r"], 9)) for r in charts.correlation_matrix(df).collect())
    monkeypatch.setattr(charts, "BLOCK_COLUMNS", 2)
    assert sorted((r["a"], r["b"], round(r["r"], 9)) for r in charts.correlation_matrix(df).collect()) == whole


def test_histogram_of_a_constant(spark):
    rows = charts.histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x").collect()
    assert len(rows) == 20 and [r["n"] for r in rows if r["n"]] == [3] and rows[10]["n"] == 3
    assert rows[0]["lo"] == 4.5 and rows[-1]["hi"] == pytest.approx(5.5)
    assert charts.histogram(spark.createDataFrame([(None,)], "x double"), "x").count() == 0


def test_profile_of_an_all_missing_column(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    rows = {r["column"]: r for r in profile.numeric_statistics(df).collect()}
    assert rows["y"]["mean"] is None and rows["y"]["n_distinct"] == 0 and rows["y"]["missing_pct"] == 100
    assert rows["x"]["std"] == pytest.approx(1.4142)
    sketch = {r["column"]: r["n_distinct"] for r in profile.numeric_statistics(df, exact_distinct=False).collect()}
    assert sketch == {"x": 2, "y": 0}
    assert profile.missing(df.where("x > 9")).agg(F.sum("n_missing")).first()[0] == 0


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "ddccbbaae"], "s string")
    assert [(r["value"], r["n"]) for r in profile.top_values(df).orderBy("rank").collect()] == [("a", 2), ("b", 2), ("c", 2)]


def test_importance_by_exchange(spark, monkeypatch):
    """A model that only reads the first column, over groups of a few rows: the others have no importance."""
    from tabloom.operators import models

    monkeypatch.setattr(models, "EXCHANGED", 16)
    rows = spark.createDataFrame([(float(i % 2), float(i % 2), float(i), 1.0) for i in range(200)], "label double, a double, b double, c double")
    rows = models.assemble(rows, ["a", "b", "c"])

    class Reader:
        def transform(self, df):
            return df.withColumn("prediction", models.vector_to_array("features")[0])

    fitted = models.Fitted("knn", Reader())
    found = models.permutation_importances(fitted, rows, ["a", "b", "c"], "classification")
    assert [f for f, _ in found] == ["a", "b", "c"] and 0.3 < found[0][1] < 0.7 and found[1][1] == found[2][1] == 0
    assert models.permutation_importances(fitted, rows, ["a", "b", "c"], "classification") == found
    errors = models.permutation_importances(fitted, rows.limit(0), ["a", "b", "c"], "regression")
    assert errors == [("a", 0.0), ("b", 0.0), ("c", 0.0)]
