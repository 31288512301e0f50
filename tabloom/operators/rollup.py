"""Rollups, lookups and joins over the metadata tables and the prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabloom.functions.records import human_size

# Fixed value: shown when the log is empty.
NO_ALGORITHM = "N/A"
RECENT = 5


def totals(users: DataFrame, datasets: DataFrame, predictions: DataFrame) -> DataFrame:
    """Three counts side by side: counted apart, then folded into one row."""
    counted = None
    for name, table in (("total_users", users), ("total_datasets", datasets), ("total_predictions", predictions)):
        one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        counted = one if counted is None else counted.unionByName(one)
    return counted.agg(*[
        F.sum(F.when(F.col("what") == n, F.col("n"))).alias(n)
        for n in ("total_users", "total_datasets", "total_predictions")
    ])


def most_used_model(predictions: DataFrame) -> DataFrame:
    return (
        predictions.groupBy("selected_model").agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.min_by("selected_model", F.struct(-F.col("n"), F.col("selected_model"))),
                        F.lit(NO_ALGORITHM)).alias("most_used_algorithm"))
    )


def best_average_confidence(predictions: DataFrame) -> DataFrame:
    return (
        predictions.where("confidence_score IS NOT NULL").groupBy("selected_model")
        .agg(F.avg("confidence_score").alias("avg_score"))
        .agg(F.bround(F.max("avg_score"), 4).alias("best_average_accuracy"))
    )


def admin_statistics(users: DataFrame, datasets: DataFrame, predictions: DataFrame) -> dict:
    """The admin page's five numbers as one record."""
    return {
        **totals(users, datasets, predictions).first().asDict(),
        **most_used_model(predictions).first().asDict(),
        **best_average_confidence(predictions).first().asDict(),
    }


def newest_first(rows: DataFrame, stamp: str, tie: str, owner: str = "user_id", user_id=None) -> DataFrame:
    """Rows of one owner newest first, or of all owners, owner by owner.

    A range-partitioned sort whose key goes on past the owner, so a busy
    owner's rows spread over many tasks.
    """
    if user_id is not None:
        return rows.where(F.col(owner) == user_id).orderBy(F.desc(stamp), F.desc(tie))
    return rows.orderBy(owner, F.desc(stamp), F.desc(tie))


def recent_per_owner(rows: DataFrame, stamp: str, tie: str, owner: str = "user_id", n: int = RECENT) -> DataFrame:
    """The n newest rows per owner; tasks keep n per owner before the exchange."""
    order = Window.partitionBy(owner).orderBy(F.desc(stamp), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def owner_lookup(rows: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows asked for by (id, owner); someone else's rows are not found."""
    return rows.join(requests.select(*keys), keys, "left_semi")


def dashboard(datasets: DataFrame, configs: DataFrame, results: DataFrame) -> DataFrame:
    """Each dataset with its size in words and what has been done to it."""
    cfg = configs.select("dataset_id", "target_column", F.lit(True).alias("__cfg"))
    res = results.select("dataset_id", F.lit(True).alias("__res"))
    return (
        datasets.join(cfg, datasets["id"] == cfg["dataset_id"], "left").drop("dataset_id")
        .join(res, datasets["id"] == res["dataset_id"], "left").drop("dataset_id")
        .withColumn("size_display", human_size(F.col("file_size")))
        .withColumn("is_configured", F.coalesce("__cfg", F.lit(False)))
        .withColumn("is_preprocessed", F.coalesce("__res", F.lit(False)))
        .drop("__cfg", "__res")
    )


def latest_with_result(datasets: DataFrame, results: DataFrame) -> DataFrame:
    """Per user the newest dataset that has a result."""
    done = datasets.join(results.select(F.col("dataset_id").alias("id")), "id", "left_semi")
    return recent_per_owner(done, "uploaded_at", "id", n=1).drop("rank")


def report_records(datasets: DataFrame, results: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per user: latest analysed dataset, its best model and the last predictions.

    Only the summary of that dataset is parsed.
    """
    latest = latest_with_result(datasets, results)
    field = lambda path: F.get_json_object("summary_json", path)
    summaries = results.select(F.col("dataset_id").alias("id"), "summary_json")
    entry = F.struct("rank", "prediction_result", "selected_model", "created_at")
    recent = recent_per_owner(predictions, "created_at", "id").groupBy("user_id").agg(
        F.array_sort(F.collect_list(entry)).alias("history"))
    return (
        latest.select("user_id", "id", F.col("original_name").alias("dataset_name"), "num_rows", "num_cols")
        .join(summaries, "id").drop("id")
        .withColumns({
            "target_column": field("$.target_column"),
            "best_model_name": F.coalesce(field("$.best_model.name"), F.lit(NO_ALGORITHM)),
            "metrics": F.from_json(field("$.model_scores"), "map<string,double>"),
        }).drop("summary_json")
        .join(recent, "user_id", "left")
    )


def dataset_totals(datasets: DataFrame) -> DataFrame:
    return datasets.agg(F.count("*").alias("n_datasets"), F.sum("num_rows").alias("total_rows"))
