"""From a file to a report: the steps a user takes, one method each."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.functions.columns import c, normalise, numeric_columns, text_columns
from tabloom.operators import charts, detect, profile, rollup
from tabloom.operators.clean import ROW_KEY
from tabloom.operators.models import TREE_DEPTH, TREES, Fitted
from tabloom.plans.config import PrepConfig
from tabloom.plans.prepare import prepare
from tabloom.plans.state import PrepState
from tabloom.plans.train import TrainResult, score_table, summary_json, train_suite
from tabloom.session import durable
from tabloom.sources.admission import admission_report, list_files
from tabloom.sources.csv_scan import read_csv
from tabloom.sources.store import SCHEMAS, MetadataStore, prediction_rows
from tabloom.sources.validation import require_config, require_valid


class Workbench:
    """Datasets of several users below one root folder.

    Everything fitted for a dataset lives in a folder that carries its id, so
    datasets never overwrite each other's models.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = MetadataStore(spark, f"{self.root}/metadata")

    def upload(self, user_id: int, path: str, limit_mb: float | None = None) -> int:
        """Admit, read, validate and register a CSV file or a folder of them.

        The table is kept as Parquet, so the text is parsed once.
        Files may be of any size unless ``limit_mb`` is given.
        """
        report = admission_report(list_files(self.spark, path), limit_mb=limit_mb)
        verdict = report.agg(F.count("*").alias("n"), F.sum("file_size").alias("size"), F.first("reason", True).alias("reason")).first()
        if not verdict["n"]:
            raise ValueError(f"no file at {path!r}")
        if verdict["reason"]:
            raise ValueError(f"file refused: {verdict['reason']}")
        table = require_valid(read_csv(self.spark, path))
        name = path.rstrip("/").rsplit("/", 1)[-1]
        kept = f"{self.root}/tables/{uuid.uuid4().hex}_{name}"
        table.write.parquet(kept)
        return self.store.register(self.spark.read.parquet(kept), user_id, kept.rsplit("/", 1)[-1], name, kept, verdict["size"])

    def _record(self, dataset_id: int, user_id: int):
        row = self.store.dataset_by_id(dataset_id, user_id).first()
        if row is None:
            raise ValueError(f"no dataset {dataset_id} of user {user_id}")
        return row

    def table(self, dataset_id: int, user_id: int) -> DataFrame:
        return self.spark.read.parquet(self._record(dataset_id, user_id)["file_path"])

    def preview(self, dataset_id: int, user_id: int, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
        """The first rows by ``order_by``, or by all columns from the left."""
        df = self.table(dataset_id, user_id)
        return profile.preview(df, [c(n) for n in order_by or df.columns], n)

    def column_report(self, dataset_id: int, user_id: int, search: str = "") -> DataFrame:
        """Type, missing cells and statistics of every column."""
        df = self.table(dataset_id, user_id)
        out = profile.column_types(df).join(profile.missing(df), "column")
        numbers, texts = profile.measured_columns(df), text_columns(df)
        if numbers:
            stats = profile.numeric_statistics(df, numbers).drop("n_missing", "missing_pct")
            out = out.join(stats, "column", "left")
        if texts:
            top = profile.top_values(df, texts).groupBy("column").agg(
                F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values"))
            counts = profile.text_statistics(df, texts).withColumnRenamed("n_distinct", "n_values").drop("n_filled")
            out = out.join(top, "column", "left").join(counts, "column", "left")
            if numbers:
                out = out.withColumn("n_distinct", F.coalesce("n_distinct", "n_values")).drop("n_values")
            else:
                out = out.withColumnRenamed("n_values", "n_distinct")
        return profile.search_columns(out, search).orderBy("position")

    def configure(self, dataset_id: int, user_id: int, target: str, problem_type: str = "auto",
                  excluded: list[str] = ()) -> str:
        """Store the target and return the problem type in effect."""
        df = self.table(dataset_id, user_id)
        require_config(df.columns, target, list(excluded))
        effective = detect.detect_problem_type(df, target) if problem_type == "auto" else problem_type
        self.store.save_config(dataset_id, user_id, target, effective, list(excluded))
        return effective

    def _folder(self, dataset_id: int) -> str:
        return f"{self.root}/dataset_{dataset_id}"

    def preprocess(self, dataset_id: int, user_id: int, models: list[str] | None = None, key: tuple[str, ...] = (),
                   detect_again: bool = True, depth: int | None = TREE_DEPTH, trees: int = TREES, **settings) -> TrainResult:
        """Prepare, train the suite, choose the best and store all of it.

        The type found at configuration saw the raw column; with
        ``detect_again`` it is found anew after cleaning unless it was chosen.
        """
        config = self.store.config_of(dataset_id).first()
        if config is None:
            raise ValueError("choose a target column first")
        df = self.table(dataset_id, user_id)
        chosen = config["problem_type"]
        found = detect.detect_problem_type(df, config["target_column"])
        problem = "auto" if detect_again and chosen == found else chosen
        prep = prepare(df, PrepConfig(
            target=config["target_column"], excluded=tuple(json.loads(config["excluded_columns"])), key=key,
            problem_type=problem, **settings))
        trained = train_suite(prep, models, depth, trees)
        folder = self._folder(dataset_id)
        prep.save(folder)
        trained.save(folder)
        self.store.save_result(
            dataset_id, user_id, summary_json(prep, trained), x_train_path=f"{folder}/rows/split=train",
            x_test_path=f"{folder}/rows/split=test", scaler_path=f"{folder}/state", encoder_path=f"{folder}/state",
            training_result_path=f"{folder}/model/{trained.best_name}")
        trained.release(self.spark)
        prep.release()
        if trained.best_name == "knn":
            trained.fitted["knn"] = Fitted.load(self.spark, "knn", f"{folder}/model/knn")
        return trained

    def charts(self, dataset_id: int, user_id: int) -> dict[str, DataFrame]:
        """The numbers behind the charts of a configured dataset, by name."""
        config = self.store.config_of(dataset_id).first()
        if config is None:
            raise ValueError("choose a target column first")
        target = config["target_column"]
        df = normalise(self.table(dataset_id, user_id)).drop(*json.loads(config["excluded_columns"]))
        numbers = numeric_columns(df)
        out = {"missing": charts.missing_ranked(df), "correlations": charts.correlation_matrix(df, numbers)}
        if target in numbers:
            out["target"] = charts.histogram(df, target)
            out["importance"] = charts.correlation_importance(df, target)
        else:
            out["target"] = charts.value_counts(df, target)
        return out

    def predict(self, dataset_id: int, user_id: int, rows: DataFrame, user_name: str = "",
                key: list[str] | None = None) -> DataFrame:
        """Score raw rows with the best model and log every prediction."""
        record = self._record(dataset_id, user_id)
        result = self.store.result_of(dataset_id).first()
        if result is None:
            raise ValueError("preprocess the dataset first")
        name = json.loads(result["summary_json"])["best_model"]["name"]
        folder = self._folder(dataset_id)
        state = PrepState.load(self.spark, f"{folder}/state")
        classes = self.spark.read.parquet(f"{folder}/classes") if state.problem_type == "classification" else None
        model = Fitted.load(self.spark, name, result["training_result_path"])
        scored = durable(score_table(rows, state, model, classes, key), "scored")
        self.store.log_predictions(prediction_rows(
            scored.where("reason IS NULL"), F.lit(user_id), F.lit(dataset_id), F.lit(record["original_name"]),
            F.lit(user_name), F.lit(name), prediction="label"))
        return scored.withColumnRenamed(ROW_KEY, "row_key")

    def delete(self, dataset_id: int, user_id: int) -> None:
        self.store.delete_dataset(dataset_id, user_id)

    def dashboard(self, user_id: int) -> DataFrame:
        rows = rollup.dashboard(self.store.datasets(), self.store.configs(), self.store.results())
        return rollup.newest_first(rows, "uploaded_at", "id", user_id=user_id)

    def history(self, user_id: int) -> DataFrame:
        return rollup.newest_first(self.store.predictions(user_id), "created_at", "id", user_id=user_id)

    def report(self, user_id: int) -> DataFrame:
        own = [t.where(c("user_id") == user_id)
               for t in (self.store.datasets(), self.store.results(), self.store.predictions(user_id))]
        return rollup.report_records(*own)

    def compact(self) -> None:
        """Merge the many small appends of every metadata table."""
        for name in SCHEMAS:
            self.store.compact(name)

    def admin(self) -> dict:
        return rollup.admin_statistics(self.store.users(), self.store.datasets(), self.store.predictions())
