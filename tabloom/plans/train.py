"""Train the suite on a prepared table, compare, choose, score new rows."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.functions.columns import c, normalise
from tabloom.operators import evaluate
from tabloom.operators.clean import ROW_KEY, row_digest
from tabloom.operators.encode import decode_labels
from tabloom.operators.models import (
    CLASSIFICATION_SUITE,
    REGRESSION_SUITE,
    TREE_DEPTH,
    TREES,
    Fitted,
    assemble,
    fit_model,
    importances,
    permutation_importances,
    reaches_depth,
)
from tabloom.operators.score import MISSING, UNKNOWN_LEVEL, typed_inputs
from tabloom.operators.split import TEST, TRAIN
from tabloom.plans.prepare import PrepResult
from tabloom.plans.state import PrepState
from tabloom.session import collecting, durable, ensure_checkpoint_dir, remove

# Rows of one part of the prepared table.
TASK_ROWS = 1 << 16

# Models trained side by side: one with few or short tasks leaves the cores to the other.
AT_ONCE = 2

SCORES = {"classification": ["accuracy", "precision", "recall", "f1"], "regression": ["mae", "mse", "rmse", "r2"]}


@dataclass
class TrainResult:
    problem_type: str
    fitted: dict[str, Fitted]
    metrics: DataFrame
    best_name: str
    features: list[str]
    capped: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    held_out: DataFrame | None = None

    def release(self, spark: SparkSession) -> None:
        """Remove the intermediate tables; a neighbour model must have been saved before."""
        remove(spark, self.tables)

    @property
    def best(self) -> Fitted:
        return self.fitted[self.best_name]

    def leaderboard(self) -> DataFrame:
        return evaluate.leaderboard(self.metrics, self.problem_type)

    def importances(self, spark: SparkSession) -> DataFrame:
        """Of the best model: its own, or by exchanging values of the rows it was evaluated on (before ``release``)."""
        rows = importances(self.best, self.features)
        if not rows and self.held_out is not None:
            rows = permutation_importances(self.best, self.held_out, self.features, self.problem_type)
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, folder: str) -> None:
        """The best model, below a folder that should carry the dataset's id."""
        self.best.save(f"{folder}/model/{self.best_name}")


def train_models(rows: DataFrame, features: list[str], problem_type: str, n_train: int, n_classes: int = 0,
                 test: DataFrame | None = None, names: list[str] | None = None, key: str = ROW_KEY,
                 depth: int | None = TREE_DEPTH, trees: int = TREES) -> TrainResult:
    """Train on ``rows``, evaluate on ``test`` or, without one, on ``rows``.

    ``depth`` and ``trees`` hold for all tree models; the result names those
    of which a tree reached the depth.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    names = names or (REGRESSION_SUITE if problem_type == "regression" else CLASSIFICATION_SUITE)
    train = assemble(rows, features)
    held_out = train if test is None else assemble(test, features)

    def fit_and_measure(name: str):
        model = fit_model(name, train, n_train, len(features), n_classes, key, depth, trees)
        predictions = model.transform(held_out).select("label", "prediction")
        measure = evaluate.regression_metrics if problem_type == "regression" else evaluate.classification_metrics
        return model, measure(predictions).first()

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(fit_and_measure), names))
    fitted = {name: model for name, (model, _) in zip(names, done)}
    lines = [(name, order, *[row[s] for s in SCORES[problem_type]]) for order, (name, (_, row)) in enumerate(zip(names, done))]
    schema = "model string, model_order long, " + ", ".join(f"{s} double" for s in SCORES[problem_type])
    metrics = spark.createDataFrame(lines, schema)
    best = evaluate.select_best(metrics, problem_type).first()["model"]
    capped = [n for n in names if "tree" in n or "forest" in n]
    return TrainResult(problem_type, fitted, metrics, best, features, [n for n in capped if reaches_depth(fitted[n], depth)],
                       held_out=held_out.select("features", "label"))


def train_suite(prep: PrepResult, names: list[str] | None = None, depth: int | None = TREE_DEPTH,
                trees: int = TREES) -> TrainResult:
    """The prepared rows are written once; every model reads them from there."""
    rows = prep.data.select(ROW_KEY, *[c(n) for n in prep.state.features], F.col("label").cast("double").alias("label"),
                            "split")
    if prep.cut.n_rows > TASK_ROWS:
        # Else every model's passes are the few tasks that the row groups of the input make.
        rows = rows.repartition(-(-prep.cut.n_rows // TASK_ROWS), ROW_KEY)
    with collecting() as tables:
        trained = _train_written(prep, durable(rows, "prepared"), names, depth, trees)
    trained.tables = tables
    return trained


def _train_written(prep: PrepResult, rows: DataFrame, names: list[str] | None, depth: int | None, trees: int) -> TrainResult:
    if prep.class_labels is not None:
        n_classes = len(prep.class_labels)
    else:
        n_classes = prep.classes.count() if prep.classes is not None else 0
    return train_models(
        rows.where(F.col("split") == TRAIN), prep.state.features, prep.state.problem_type,
        prep.cut.n_rows - prep.cut.n_test, n_classes, rows.where(F.col("split") == TEST), names, depth=depth, trees=trees)


def summary_json(prep: PrepResult, trained: TrainResult | None = None) -> str:
    """Run summary in the shape the report queries read."""
    out = {
        "target_column": prep.state.target,
        "problem_type": prep.state.problem_type,
        "feature_columns": prep.state.features,
        "scaled_columns": list(prep.state.scaler),
        "scale_method": prep.config.scale_method,
        "test_size": prep.config.test_size,
        "original_shape": [prep.facts["n_read"], prep.facts["n_columns"]],
        "final_shape": [prep.cut.n_rows, len(prep.state.features)],
        "duplicates_removed": prep.facts["n_copies"],
        "missing_handled": {s[1]: s[2] for s in prep.steps if s[0] == "missing" and s[1] is not None},
        "encoded_columns": {s[1]: s[2] for s in prep.steps if s[0] == "encode"},
        "train_samples": prep.cut.n_rows - prep.cut.n_test,
        "test_samples": prep.cut.n_test,
        "steps": [dict(zip(("step", "column", "action", "n_affected", "detail"), s)) for s in prep.steps],
    }
    if trained is not None:
        rows = [r.asDict() for r in trained.metrics.collect()]
        score = "r2" if trained.problem_type == "regression" else "accuracy"
        out["at_depth_limit"] = trained.capped
        out["model_scores"] = {r["model"]: r[score] for r in rows}
        best = next(r for r in rows if r["model"] == trained.best_name)
        out["best_model"] = {"name": trained.best_name,
                             "metrics": {s: best[s] for s in SCORES[trained.problem_type]}}
    return json.dumps(out)


def score_table(raw: DataFrame, state: PrepState, fitted: Fitted, classes: DataFrame | None = None,
                key: list[str] | None = None) -> DataFrame:
    """Score raw rows with the stored state and a trained model.

    A row with a cell that is no number where one is needed, that is missing
    without a stored fill, or whose category the encoding has never seen,
    comes back with a ``reason`` and no prediction. ``percentages`` has every
    class's probability by class index. A ``key`` that names two rows alike
    is refused; without one a digest of the row names it, and identical rows
    share a name.
    """
    absent = [n for n in state.inputs if n not in raw.columns]
    if absent:
        raise ValueError(f"the input lacks column(s) {absent}")
    rows = normalise(raw)
    row_key = F.concat_ws("|", *[c(n).cast("string") for n in key]) if key else row_digest(rows.columns)
    named = rows.select(row_key.alias(ROW_KEY), *[c(n) for n in state.inputs])
    if key:
        repeated = named.groupBy(ROW_KEY).count().where("count > 1").first()
        if repeated is not None:
            raise ValueError(f"the key {list(key)} names {repeated['count']} rows {repeated[ROW_KEY]!r}")
    given = {n: f"__given_{i}" for i, n in enumerate(n for n in state.inputs if n in state.levels.binary())}
    typed = typed_inputs(named, state.inputs, state.number_types, [ROW_KEY], "__reason",
                         {*state.fills.dropped, *state.levels.dropped}).withColumns(
        {g: c(n) for n, g in given.items()})
    features = state.apply(typed, keep=[ROW_KEY, "__reason", *given.values()])
    missing = [
        F.when(c(n).isNull(), F.when(c(given[n]).isNotNull(), F.lit(f"{n}: {UNKNOWN_LEVEL}")).otherwise(F.lit(f"{n}: {MISSING}"))
               if n in given else F.lit(f"{n}: {MISSING}"))
        for n in state.features]
    checked = features.withColumn("reason", F.coalesce("__reason", *missing))
    good = checked.where("reason IS NULL")
    scored = fitted.score(assemble(good, state.features)).select(ROW_KEY, "prediction", "confidence", "shares")
    if classes is not None:
        scored = decode_labels(scored, classes, "prediction", "label")
    else:
        scored = scored.withColumn("label", F.col("prediction"))
    nothing = F.lit(None)
    scored = scored.select(
        ROW_KEY, "prediction", F.col("label").cast("string").alias("label"), "confidence",
        F.transform("shares", lambda x: F.bround(x * 100, 1)).alias("percentages"), nothing.cast("string").alias("reason"))
    turned_away = checked.where("reason IS NOT NULL").select(
        ROW_KEY, nothing.cast("double").alias("prediction"), nothing.cast("string").alias("label"),
        nothing.cast("double").alias("confidence"), nothing.cast("array<double>").alias("percentages"), "reason")
    return scored.unionByName(turned_away)
