import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.columns import c
from tabloom.operators import score
from tabloom.operators.clean import ROW_KEY
from tabloom.operators.models import Fitted, assemble
from tabloom.plans import PrepConfig, PrepState, prepare, score_table, train_suite
from tabloom.plans.train import summary_json, train_models

SCHEMA = ("id long, price string, city string, sex string, age double, mostly double, note string, "
          "`a.b c` long, flag boolean, target string")


def people(n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        age = None if i % 9 == 0 else float(rng.integers(18, 80))
        target = None if i % 20 == 3 else ("old" if (age or 50) > 48 else "young")
        rows.append((i, f"${rng.integers(100, 9000):,}", None if i % 7 == 0 else "ABCD"[rng.integers(0, 4)],
                     "mf"[i % 2], age, 1.0 if i % 5 == 0 else None, f"note {i}", int(rng.integers(0, 5)), bool(i % 3), target))
    return rows + [(n + i, *r[1:]) for i, r in enumerate(rows[:10])]


def expected(rows):
    """The same preparation in pandas, step by step, without scaling."""
    df = pd.DataFrame(rows, columns=["id", "price", "city", "sex", "age", "mostly", "note", "a.b c", "flag", "target"])
    df = df.drop(columns=["note"])
    df = df[~df.drop(columns=["id"]).duplicated()]
    df["price"] = pd.to_numeric(df["price"].str.replace("[$,]", "", regex=True))
    df = df.drop(columns=["mostly"])
    df["age"] = df["age"].fillna(df["age"].median())
    df["city"] = df["city"].fillna(df["city"].mode()[0])
    df = df[df["target"].notna()]
    df["sex"] = (df["sex"] == "m").astype(int)
    df = pd.concat([df.drop(columns=["city"]), pd.get_dummies(df["city"], prefix="city", dtype=int)], axis=1)
    return df.set_index("id")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(people(), SCHEMA)


CONFIG = PrepConfig(target="target", key=("id",), excluded=("id", "note", "unknown", "target"))


def test_steps_match_pandas(spark, table):
    want = expected(people())
    got = prepare(table, PrepConfig(target="target", key=("id",), excluded=("id", "note"), scale_method="none"))
    assert got.state.features == [n for n in want.columns if n != "target"]
    pdf = got.data.toPandas()
    pdf.index = pdf[ROW_KEY].astype(int)
    pdf, want = pdf.sort_index(), want.sort_index()
    assert list(pdf.index) == list(want.index)
    for n in got.state.features:
        assert np.allclose(pdf[n].astype(float), want[n].astype(float)), n
    assert list(pdf["label"]) == [["old", "young"].index(v) for v in want["target"]]
    assert got.state.scaler == {}


def test_invariants(spark, table):
    got = prepare(table, CONFIG)
    n = len(expected(people()))
    rows = got.data
    counts = dict(rows.groupBy("split").count().collect())
    assert counts["test"] == int(np.ceil(n * 0.2)) and sum(counts.values()) == n
    assert rows.select(ROW_KEY).distinct().count() == n
    scaled = [n for n in got.state.features if n != "flag"]
    for r in (rows.agg(*[F.avg(c(n)).alias(n) for n in scaled]).first(),):
        assert all(abs(v) < 1e-9 for v in r)
    assert all(abs(v - 1) < 1e-9 for v in rows.agg(*[F.stddev_pop(c(n)) for n in scaled]).first())
    again = prepare(table.repartition(13), CONFIG)
    assert again.cut == got.cut
    key = lambda df: sorted((r[ROW_KEY], r["split"], r["label"]) for r in df.collect())
    assert key(again.data) == key(rows)


def test_row_without_key_gets_a_digest(spark, table):
    got = prepare(table.drop("id"), PrepConfig(target="target", excluded=("note",)))
    assert got.cut.n_rows == len(expected(people()))
    assert got.data.select(ROW_KEY).distinct().count() == got.cut.n_rows


def test_problem_type_override_and_strategies(spark, table):
    got = prepare(table, PrepConfig(target="a.b c", key=("id",), excluded=("id", "note"), problem_type="regression"))
    assert got.state.problem_type == "regression" and got.classes is None
    dropped = prepare(table, PrepConfig(target="target", key=("id",), excluded=("id", "note"), missing_strategy="drop"))
    assert set(dropped.state.fills.dropped) == {"city", "age", "mostly"}
    whole = prepare(table, PrepConfig(target="target", key=("id",), excluded=("id", "note", "mostly"), missing_strategy="drop_rows"))
    assert whole.cut.n_rows == len(pd.DataFrame(people()[:240]).drop(columns=[0, 5]).dropna().drop_duplicates())
    trained_on = prepare(table, PrepConfig(target="target", key=("id",), excluded=("id", "note"), scale_on="train"))
    means = trained_on.train().agg(F.avg("price")).first()[0]
    assert abs(means) < 1e-9


@pytest.mark.parametrize("wrong", [{"scale_method": "minmax"}, {"missing_strategy": "mean"}, {"test_size": 1.0},
                                   {"problem_type": "ranking"}, {"scale_on": "test"}, {"key": ("target",)}])
def test_bad_settings_are_refused(wrong):
    with pytest.raises(ValueError):
        PrepConfig(target="target", **wrong)


def test_missing_target_column(table):
    with pytest.raises(ValueError):
        prepare(table, PrepConfig(target="nope"))


def test_state_round_trip_reproduces_training_features(spark, table, tmp_path):
    got = prepare(table, CONFIG)
    got.save(str(tmp_path / "dataset_1"))
    state = PrepState.load(spark, str(tmp_path / "dataset_1/state"))
    assert state == got.state
    stored = spark.read.parquet(str(tmp_path / "dataset_1/rows"))
    assert stored.where("split = 'test'").count() == got.cut.n_test
    raw = table.withColumn(ROW_KEY, F.col("id").cast("string"))
    again = state.apply(raw, keep=[ROW_KEY]).join(got.data.select(ROW_KEY), ROW_KEY, "left_semi")
    cols = [ROW_KEY] + got.state.features
    one = sorted(tuple(r) for r in again.select(*[c(n) for n in cols]).collect())
    two = sorted(tuple(r) for r in got.data.select(*[c(n) for n in cols]).collect())
    assert one == two


def test_suite_on_a_prepared_table(spark, table, tmp_path):
    prep = prepare(table, CONFIG)
    trained = train_suite(prep, depth=4)
    metrics = {r["model"]: r for r in trained.metrics.collect()}
    assert list(metrics) == ["logistic_regression", "decision_tree", "random_forest", "knn", "svm"]
    assert metrics["decision_tree"]["accuracy"] > 0.8
    assert metrics["svm"]["accuracy"] > 0.6
    assert '"best_model"' in summary_json(prep, trained)
    for name, model in trained.fitted.items():
        path = str(tmp_path / name)
        model.save(path)
        loaded = Fitted.load(spark, name, path)
        scored = score_table(table, prep.state, loaded, prep.classes, key=["id"])
        rows = scored.collect()
        assert len(rows) == 250 and {r["label"] for r in rows} <= {"old", "young"}
        confident = [r["confidence"] for r in rows]
        assert all(v is None for v in confident) if name == "svm" else all(0 < v <= 1 for v in confident)
    assert trained.best_name in metrics
    assert trained.leaderboard().count() == 5


def test_scoring_sorts_out_bad_rows(spark, table):
    prep = prepare(table, CONFIG)
    trained = train_suite(prep, ["logistic_regression"])
    rows = spark.createDataFrame([
        (1, "$500", "A", "m", 30.0, None, "n", 2, True, None),
        (2, "$500", "Z", "m", None, None, "n", 2, True, None),
        (3, "$500", "A", "x", 30.0, None, "n", 2, True, None),
        (4, "abc", "A", "m", 30.0, None, "n", 2, True, None)], SCHEMA).drop("target")
    got = {r[ROW_KEY]: (r["label"], r["reason"]) for r in score_table(rows, prep.state, trained.best, prep.classes, ["id"]).collect()}
    assert got["1"][1] is None and got["2"][1] is None
    assert got["3"] == (None, "sex: unknown level") and got["4"] == (None, "price: not numeric")
    with pytest.raises(ValueError, match="names 2 rows"):
        score_table(rows.unionByName(rows.where("id = 1")), prep.state, trained.best, prep.classes, ["id"])
    scored = score_table(rows, prep.state, trained.best, prep.classes, ["id"]).where("reason IS NULL").collect()
    assert all(abs(sum(r["percentages"]) - 100) <= 0.1 and r["confidence"] == pytest.approx(max(r["percentages"]) / 100, abs=1e-3)
               for r in scored)
    shares = trained.best.class_shares(assemble(prep.test(), prep.state.features), ROW_KEY)
    pct = score.class_percentages(shares, prep.classes, ROW_KEY)
    assert pct.groupBy(ROW_KEY).agg(F.sum("percentage").alias("s")).where("abs(s - 100) > 0.11").count() == 0


def test_input_check(spark):
    rows = spark.createDataFrame([(1, "1_000", "nan"), (2, "", "x"), (3, None, "1"), (4, "5", "1d"), (5, " 7 ", "-inf")],
                                 "id long, a string, b string")
    checked = score.validate_inputs(rows, ["a", "b"])
    assert {r["id"]: r["reason"] for r in score.rejected(checked).collect()} == {
        2: "a: missing", 3: "a: missing", 4: "b: not numeric"}
    assert {r["id"]: r["a"] for r in score.accepted(checked).collect()} == {1: 1000.0, 5: 7.0}
    with pytest.raises(ValueError):
        score.validate_inputs(rows, ["zzz"])


def test_intermediate_tables_are_removed(spark, table, tmp_path):
    from pathlib import Path

    from tabloom.session import shared_dir

    folder = Path(shared_dir(spark)) / spark.sparkContext.applicationId
    before = set(folder.glob("*"))
    prep = prepare(table, CONFIG)
    trained = train_suite(prep, ["decision_tree"], depth=1)
    assert set(folder.glob("*")) > before and trained.capped == ["decision_tree"]
    prep.save(str(tmp_path / "dataset_3"))
    trained.release(spark)
    prep.release()
    assert set(folder.glob("*")) <= before


def test_tiny_classifier_trains_without_a_test_part(spark):
    rows = [(str(i), 7.0 - 2 * i, 0.5 * i * i, float(i >= 4)) for i in range(9)]
    df = spark.createDataFrame(rows, f"{ROW_KEY} string, feature_1 double, feature_2 double, label double")
    got = train_models(df, ["feature_1", "feature_2"], "classification", 9, 2, depth=4)
    assert {r["model"] for r in got.metrics.collect()} == {"logistic_regression", "decision_tree", "random_forest", "knn", "svm"}
    assert got.metrics.where("accuracy < 0").count() == 0


def test_two_clusters_are_separated(spark, tmp_path):
    rows = [(str(i), (i // 4) + 0.05 * (i % 4), (i // 4) + 0.04 * (i % 4), float(i // 4)) for i in range(8)]
    df = spark.createDataFrame(rows, f"{ROW_KEY} string, x double, y double, label double")
    got = train_models(df, ["x", "y"], "classification", 8, 2, depth=4)
    best = got.metrics.where(F.col("model") == got.best_name).first()
    assert best["f1"] == 1.0 and best["accuracy"] == 1.0
    got.save(str(tmp_path / "dataset_2"))
    assert (tmp_path / "dataset_2" / "model" / got.best_name).exists()


def test_regression_suite(spark):
    rows = [(i, float(i), float(i % 7), 3.0 * i + (i % 7)) for i in range(120)]
    prep = prepare(spark.createDataFrame(rows, "id long, a double, b double, y double"), PrepConfig(target="y", key=("id",)))
    trained = train_suite(prep, ["linear_regression", "decision_tree_regressor"], depth=5)
    assert trained.best_name == "linear_regression"
    assert trained.metrics.where("model = 'linear_regression'").first()["r2"] == pytest.approx(1.0)
    assert trained.importances(spark).first()["feature"] == "a"
