"""Metrics, best model, leaderboard on rule-based predictions."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import Tables, query
from tabloom.operators import evaluate

_RULES = {
    "by_discount": "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END",
    "by_status": "CASE WHEN l_linestatus = 'O' THEN 'R' ELSE 'A' END",
    "always_n": "'N'",
}


def class_predictions(t: Tables):
    guesses = [F.struct(F.lit(m).alias("model"), F.lit(i).cast("long").alias("model_order"), F.expr(rule).alias("prediction"))
               for i, (m, rule) in enumerate(_RULES.items())]
    return t.lineitem.select(F.col("l_returnflag").alias("label"), F.inline(F.array(*guesses)))


_CLASS_ROWS = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {i} AS model_order, l_returnflag AS label, {rule} AS prediction FROM lineitem"
    for i, (m, rule) in enumerate(_RULES.items()))

_CLASS_METRICS = f"""
rows AS ({_CLASS_ROWS}),
per AS (
  SELECT model, model_order, cls,
    (SELECT count(*) FROM rows r WHERE r.model = k.model AND r.label = cls) AS support,
    (SELECT count(*) FROM rows r WHERE r.model = k.model AND r.prediction = cls) AS predicted,
    (SELECT count(*) FROM rows r WHERE r.model = k.model AND r.label = cls AND r.prediction = cls) AS hits
  FROM (SELECT DISTINCT model, model_order, label AS cls FROM rows) k),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p, hits / support AS r FROM per),
metrics AS (
  SELECT model, model_order, round(sum(hits) / sum(support), 6) AS accuracy,
    round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall,
    round(sum(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * support) / sum(support), 6) AS f1
  FROM pr GROUP BY model, model_order)"""


def _class_metrics(t: Tables):
    metrics = evaluate.classification_metrics(class_predictions(t), by=["model", "model_order"])
    return metrics.select("model", "model_order", *[F.round(n, 6).alias(n) for n in ("accuracy", "precision", "recall", "f1")])


@query("metrics_classification", f"WITH {_CLASS_METRICS} SELECT model, accuracy, precision, recall, f1 FROM metrics")
def metrics_classification(t: Tables):
    return _class_metrics(t).drop("model_order")


_VALUES = {"price_x_quantity": "l_quantity * p_retailprice", "flat_rate": "l_quantity * 1500.0", "constant": "38000.0"}


def value_predictions(t: Tables):
    guesses = [F.struct(F.lit(m).alias("model"), F.lit(i).cast("long").alias("model_order"),
                        F.expr(rule).cast("double").alias("prediction")) for i, (m, rule) in enumerate(_VALUES.items())]
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_extendedprice").alias("label"), F.inline(F.array(*guesses)))


_VALUE_ROWS = " UNION ALL ".join(
    f"""SELECT '{m}' AS model, {i} AS model_order, l_extendedprice AS label, CAST({rule} AS DOUBLE) AS prediction
    FROM lineitem JOIN part ON l_partkey = p_partkey""" for i, (m, rule) in enumerate(_VALUES.items()))

_VALUE_METRICS = f"""
metrics AS (
  SELECT model, model_order, round(avg(abs(label - prediction)), 4) AS mae, round(avg((label - prediction) ** 2), 2) AS mse,
    round(sqrt(avg((label - prediction) ** 2)), 4) AS rmse,
    round(1 - avg((label - prediction) ** 2) / var_pop(label), 6) AS r2
  FROM ({_VALUE_ROWS}) GROUP BY model, model_order)"""


def _value_metrics(t: Tables):
    m = evaluate.regression_metrics(value_predictions(t), by=["model", "model_order"])
    return m.select("model", "model_order", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"),
                    F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("metrics_regression", f"WITH {_VALUE_METRICS} SELECT model, mae, mse, rmse, r2 FROM metrics")
def metrics_regression(t: Tables):
    return _value_metrics(t).drop("model_order")


@query("select_best", f"""
WITH {_CLASS_METRICS} SELECT model, f1, accuracy FROM metrics ORDER BY f1 DESC, accuracy DESC, model_order LIMIT 1""")
def select_best(t: Tables):
    return evaluate.select_best(_class_metrics(t), "classification").select("model", "f1", "accuracy")


@query("select_best_regression", f"""
WITH {_VALUE_METRICS} SELECT model, rmse, r2 FROM metrics ORDER BY rmse, r2 DESC, model_order LIMIT 1""")
def select_best_regression(t: Tables):
    return evaluate.select_best(_value_metrics(t), "regression").select("model", "rmse", "r2")


@query("leaderboard", f"WITH {_CLASS_METRICS} SELECT model, accuracy AS score FROM metrics ORDER BY score DESC, model")
def leaderboard(t: Tables):
    return evaluate.leaderboard(_class_metrics(t), "classification")


@query("leaderboard_regression", f"WITH {_VALUE_METRICS} SELECT model, r2 AS score FROM metrics ORDER BY score DESC, model")
def leaderboard_regression(t: Tables):
    return evaluate.leaderboard(_value_metrics(t), "regression")
