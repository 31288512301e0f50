"""Rollups and joins over metadata and the prediction log."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import Tables, query
from tabloom.functions.records import human_size, json_to_list, list_to_json
from tabloom.operators import rollup


def datasets(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat("o_orderpriority", F.lit(".csv")).alias("original_name"),
        F.floor("o_totalprice").alias("num_rows"), F.col("o_custkey").alias("num_cols"),
        (F.col("o_orderkey") * F.col("o_custkey")).alias("file_size"), F.col("o_orderdate").alias("uploaded_at"))


def predictions(t: Tables):
    return t.events.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("selected_model"),
        F.col("props").alias("prediction_result"), F.col("ts").alias("created_at"),
        F.expr("CASE WHEN event_type <> 'view' THEN value END").alias("confidence_score"))


def configs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("dataset_id"), F.col("lang").alias("target_column"))


def results(t: Tables):
    model = F.expr("CASE WHEN quality = 1 THEN 'random_forest' ELSE 'knn' END")
    summary = F.to_json(F.struct(
        F.concat(F.lit("t"), "toxic").alias("target_column"), F.struct(model.alias("name")).alias("best_model"),
        F.struct((F.col("quality") / 2).alias("knn"), F.lit(0.25).alias("svm")).alias("model_scores")))
    return t.labels.select(F.col("doc_id").alias("dataset_id"), summary.alias("summary_json"))


@query("admin_totals", """
SELECT (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM orders) AS total_datasets,
       (SELECT count(*) FROM events) AS total_predictions""")
def admin_totals(t: Tables):
    return rollup.totals(t.customer, datasets(t), predictions(t))


@query("admin_most_used", """
SELECT event_type AS most_used_algorithm FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""")
def admin_most_used(t: Tables):
    return rollup.most_used_model(predictions(t))


@query("admin_best_avg", """
SELECT round_even(max(a), 4) AS best_average_accuracy
FROM (SELECT avg(value) AS a FROM events WHERE event_type <> 'view' GROUP BY event_type)""")
def admin_best_avg(t: Tables):
    return rollup.best_average_confidence(predictions(t))


@query("history_by_user", """
SELECT user_id, event_id AS id, event_type AS selected_model, CASE WHEN event_type <> 'view' THEN value END AS confidence_score
FROM events ORDER BY user_id, ts DESC, event_id DESC""")
def history_by_user(t: Tables):
    return rollup.newest_first(predictions(t), "created_at", "id").select(
        "user_id", "id", "selected_model", "confidence_score")


@query("recent5_per_user", """
SELECT user_id, event_id AS id, event_type AS selected_model,
       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
FROM events QUALIFY rank <= 5""")
def recent5_per_user(t: Tables):
    return rollup.recent_per_owner(predictions(t), "created_at", "id").select("user_id", "id", "selected_model", "rank")


@query("datasets_by_user", """
SELECT o_custkey AS user_id, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS num_rows
FROM orders ORDER BY 1, o_orderdate DESC, 2 DESC""")
def datasets_by_user(t: Tables):
    return rollup.newest_first(datasets(t), "uploaded_at", "id").select("user_id", "id", "num_rows")


_SIZE = """CASE WHEN {s} < 1024 THEN {s} || ' B' WHEN {s} < 1048576 THEN printf('%.1f KB', round_even({s} / 1024.0, 1)::DOUBLE)
 ELSE printf('%.1f MB', round_even({s} / 1048576.0, 1)::DOUBLE) END"""


@query("dashboard_join", f"""
SELECT o_orderkey AS id, o_custkey AS user_id, {_SIZE.format(s='(o_orderkey * o_custkey)')} AS size_display,
       d.lang AS target_column, d.doc_id IS NOT NULL AS is_configured, l.doc_id IS NOT NULL AS is_preprocessed
FROM orders LEFT JOIN documents d ON o_orderkey = d.doc_id LEFT JOIN labels l ON o_orderkey = l.doc_id""")
def dashboard_join(t: Tables):
    return rollup.dashboard(datasets(t), configs(t), results(t)).select(
        "id", "user_id", "size_display", "target_column", "is_configured", "is_preprocessed")


_LATEST = """
latest AS (SELECT o_custkey AS user_id, o_orderkey AS id, o_orderpriority || '.csv' AS dataset_name,
                  CAST(floor(o_totalprice) AS BIGINT) AS num_rows, o_custkey AS num_cols
           FROM orders WHERE o_orderkey IN (SELECT doc_id FROM labels)
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


@query("latest_with_result", f"WITH {_LATEST} SELECT user_id, id, num_rows FROM latest")
def latest_with_result(t: Tables):
    return rollup.latest_with_result(datasets(t), results(t)).select("user_id", "id", "num_rows")


@query("report_record", f"""
WITH {_LATEST},
recent AS (SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
           FROM events QUALIFY k <= 5),
history AS (SELECT user_id, string_agg(event_type || '=' || props, ';' ORDER BY k) AS history FROM recent GROUP BY 1)
SELECT user_id, dataset_name, num_rows, num_cols, 't' || toxic AS target_column,
       CASE WHEN quality = 1 THEN 'random_forest' ELSE 'knn' END AS best_model_name, quality / 2 AS knn_score, history
FROM latest JOIN labels ON id = doc_id LEFT JOIN history USING (user_id)""")
def report_record(t: Tables):
    lines = F.transform("history", lambda h: F.concat(h["selected_model"], F.lit("="), h["prediction_result"]))
    return rollup.report_records(datasets(t), results(t), predictions(t)).select(
        "user_id", "dataset_name", "num_rows", "num_cols", "target_column", "best_model_name",
        F.col("metrics")["knn"].alias("knn_score"), F.array_join(lines, ";").alias("history"))


@query("datasets_totals", """
SELECT count(*) AS n_datasets, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_rows FROM orders""")
def datasets_totals(t: Tables):
    return rollup.dataset_totals(datasets(t))


@query("format_size", f"SELECT doc_id, {_SIZE.format(s='(n_chars * n_chars)')} AS size_display FROM documents")
def format_size(t: Tables):
    return t.documents.select("doc_id", human_size(F.col("n_chars") * F.col("n_chars")).alias("size_display"))


@query("json_props", """
SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, event_type || ',' || user_id AS excluded, 2 AS n_excluded,
       '["' || event_type || '","' || user_id || '"]' AS excluded_json FROM events""")
def json_props(t: Tables):
    stored = list_to_json(F.array(F.col("event_type"), F.col("user_id").cast("string")))
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), stored.alias("excluded_json"))
    parsed = json_to_list(F.col("excluded_json"))
    return rows.select("event_id", "k", F.array_join(parsed, ",").alias("excluded"), F.size(parsed).alias("n_excluded"),
                       "excluded_json")
