"""Metrics from small tables, and the choice of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MODEL_COLUMNS = ["model", "model_order"]


def confusion_counts(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: list[str] | None = None) -> DataFrame:
    """Rows per (label, prediction): the only step that reads the data."""
    return predictions.groupBy(
        *(by or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count("*").alias("n"))


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                           by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1.

    A class never predicted has precision 0. Each confusion count adds to its
    true class and to its predicted class, so no join is needed.
    """
    by = by or []
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"),
                 hit.cast("long").alias("hits")),
        F.struct(F.col("prediction").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("hits")),
    )
    per_class = (
        confusion_counts(predictions, label, prediction, by)
        .select(*by, F.inline(sides))
        .groupBy(*by, "cls")
        .agg(*[F.sum(n).cast("double").alias(n) for n in ("support", "predicted", "hits")])
    )
    p = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    scored = per_class.select(*by, "support", "hits", p.alias("p"), r.alias("r")).withColumn(
        "f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    total = F.sum("support")

    def weighted(name):
        return F.try_divide(F.sum(F.col(name) * F.col("support")), total)

    return scored.groupBy(*by).agg(
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        weighted("p").alias("precision"),
        weighted("r").alias("recall"),
        weighted("f").alias("f1"),
    )


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: list[str] | None = None) -> DataFrame:
    """MAE, MSE, RMSE and R² in one pass.

    On a constant label R² is 1 for a perfect prediction and 0 otherwise.
    """
    y = F.col(label).cast("double")
    error = y - F.col(prediction).cast("double")
    facts = predictions.groupBy(*(by or [])).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("spread"))
    constant = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("spread") == 0, constant).otherwise(1 - F.try_divide("mse", "spread"))
    return facts.select(*(by or []), "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def select_best(metrics: DataFrame, problem_type: str) -> DataFrame:
    """Best row of a metric table that has ``model`` and ``model_order``.

    Regression: least RMSE, then greatest R². Classification: greatest F1,
    then accuracy. A full tie goes to the model trained first.
    """
    if problem_type == "regression":
        order = [F.asc_nulls_last("rmse"), F.desc_nulls_last("r2")]
    else:
        order = [F.desc_nulls_last("f1"), F.desc_nulls_last("accuracy")]
    return metrics.orderBy(*order, "model_order").limit(1)


def leaderboard(metrics: DataFrame, problem_type: str) -> DataFrame:
    score = "r2" if problem_type == "regression" else "accuracy"
    return metrics.select("model", F.col(score).alias("score")).orderBy(F.desc("score"), "model")
