"""CSV scan, admission, validation, table writes."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import Tables, query
from tabloom.operators.split import split_exact
from tabloom.session import scratch_path
from tabloom.sources.admission import admission_report, list_files, table_sizes
from tabloom.sources.csv_scan import overlong_rows, read_csv, scan_text
from tabloom.sources.store import (
    MetadataStore,
    dataset_record,
    delete_children,
    delete_owned,
    insert_if_absent,
    prediction_rows,
    upsert_latest,
)
from tabloom.sources.validation import config_reasons, input_feature_table, validation_rules


def _as_csv(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return read_csv(df.sparkSession, path)


@query("csv_scan_typed", """
SELECT o_orderkey, CAST(nullif(o_custkey, 1) AS DOUBLE) AS o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
       o_orderstatus = 'O' AS is_open
FROM orders""")
def csv_scan_typed(t: Tables):
    rows = t.orders.select(
        "o_orderkey", F.expr("nullif(o_custkey, 1)").alias("o_custkey"), "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN 'N/A' ELSE o_orderpriority END").alias("o_orderpriority"),
        (F.col("o_orderstatus") == "O").alias("is_open"))
    return _as_csv(rows, "orders-csv")


@query("csv_scan_quoted", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_scan_quoted(t: Tables):
    return _as_csv(t.documents.select("doc_id", "text", "lang", "source", "n_chars"), "documents-csv")


@query("csv_scan_mixed_headers", """
SELECT o_orderkey, o_totalprice, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""")
def csv_scan_mixed_headers(t: Tables):
    """Two files with the same columns in another order."""
    path = scratch_path(t.spark, "orders-mixed")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    status = F.col("o_orderstatus") == "O"
    rows.where(status).write.option("header", True).csv(path)
    rows.where(~status).select(*reversed(rows.columns)).write.mode("append").option("header", True).csv(path)
    return read_csv(t.spark, path).select(*rows.columns)


@query("csv_scan_overlong", """
SELECT count(*) FILTER (o_orderstatus = 'P') AS n_overlong, count(*) AS n_rows FROM orders""")
def csv_scan_overlong(t: Tables):
    """Rows with more fields than the header are counted, not cut."""
    path = scratch_path(t.spark, "orders-overlong")
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.lit("lost")))
    t.orders.select(line.alias("o_orderkey,o_orderstatus")).write.option("header", True).option("sep", "\x01").csv(path)
    text = scan_text(t.spark, path)
    return text.agg(F.lit(overlong_rows(text)).cast("long").alias("n_overlong"), F.count("*").alias("n_rows"))


@query("file_admission", """
SELECT doc_id, source || '_' || doc_id || '.' || upper(lang) AS file_name, n_chars AS file_size, lang AS extension,
       (lang IN ('en', 'fr') AND n_chars <= 2097) AS admitted,
       CASE WHEN lang NOT IN ('en', 'fr') THEN 'extension' WHEN n_chars > 2097 THEN 'size' END AS reason
FROM documents""")
def file_admission(t: Tables):
    files = t.documents.select(
        "doc_id", F.concat("source", F.lit("_"), "doc_id", F.lit("."), F.upper("lang")).alias("file_name"),
        F.col("n_chars").alias("file_size"))
    return admission_report(files, limit_mb=0.002, extensions=["en", "fr"])


# The folder whose lineitem file has as many rows as the table: the files that the tables are read from.
_FILES = """(
  SELECT parse_filename(filename) AS file_name, size FROM read_blob('/root/testdata/sf*/*.parquet')
  WHERE parse_dirpath(filename) = (SELECT min(parse_dirpath(file_name)) FROM parquet_file_metadata('/root/testdata/sf*/lineitem.parquet')
                                   WHERE num_rows = (SELECT count(*) FROM lineitem)))"""


@query("file_admission_scan", f"""
SELECT file_name, size AS file_size, 'parquet' AS extension, size <= 1048576 AS admitted,
       CASE WHEN size > 1048576 THEN 'size' END AS reason
FROM {_FILES}""")
def file_admission_scan(t: Tables):
    return admission_report(list_files(t.spark, t.folder), limit_mb=1, extensions=["csv", "parquet"])


@query("validate_dataset", """
WITH f AS (SELECT count(*) AS n FROM orders)
SELECT 'not_empty' AS rule, n > 0 AS ok, CAST(n AS VARCHAR) AS detail FROM f
UNION ALL SELECT 'enough_rows', n >= 3, CAST(n AS VARCHAR) FROM f
UNION ALL SELECT 'enough_columns', true, '7'
UNION ALL SELECT 'no_empty_column', n = 0, 'blank' FROM f""")
def validate_dataset(t: Tables):
    return validation_rules(t.orders.withColumn("blank", F.expr("nullif(o_orderkey, o_orderkey)")))


_REGISTERED = [(1, "lineitem", 11), (1, "orders", 6), (2, "events", 6), (3, "documents", 5)]


@query("register_dataset", " UNION ALL ".join(f"""
SELECT CAST({user} AS BIGINT) AS user_id, '{name}.parquet' AS filename, '{name}' AS original_name,
       'tables/{name}' AS file_path, count(*) AS num_rows, CAST({cols} AS BIGINT) AS num_cols,
       (SELECT size FROM {_FILES} WHERE file_name = '{name}.parquet') AS file_size FROM {name}""" for user, name, cols in _REGISTERED))
def register_dataset(t: Tables):
    """With the sizes that the listing gives, of one row per table."""
    sizes = dict(table_sizes(t.spark, t.folder).where(
        F.col("name").isin([f"{name}.parquet" for _, name, _ in _REGISTERED])).collect())
    rows = [dataset_record(getattr(t, name), user, f"{name}.parquet", name, f"tables/{name}", sizes[f"{name}.parquet"])
            for user, name, _ in _REGISTERED]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("log_compacted", """
SELECT user_id, event_id AS dataset_id, event_type AS selected_model, props AS prediction_result,
       CASE WHEN event_type <> 'view' THEN value END AS confidence_score FROM events WHERE user_id % 50 = 7""")
def log_compacted(t: Tables):
    """Three appends, a compaction after two, and the log of some users."""
    store = MetadataStore(t.spark, scratch_path(t.spark, "log-store"))
    scored = t.events.withColumn("confidence", F.expr("CASE WHEN event_type <> 'view' THEN value END"))
    for late in range(3):
        store.log_predictions(prediction_rows(
            scored.where(F.pmod("event_id", F.lit(3)) == late), F.col("user_id"), F.col("event_id"), F.lit("set"), F.lit("user"),
            F.col("event_type"), "props"))
        if late == 1:
            store.compact("prediction_history")
    return store.predictions().where("user_id % 50 = 7").select(
        "user_id", "dataset_id", "selected_model", "prediction_result", "confidence_score")


@query("upsert_latest", """
SELECT o_custkey AS dataset_id, o_orderkey AS id, o_orderpriority AS target_column, o_totalprice
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def upsert(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("id"),
                           F.col("o_orderpriority").alias("target_column"), "o_totalprice", "o_orderdate", "o_orderstatus")
    changed = F.col("o_orderstatus") == "P"
    return upsert_latest(rows.where(~changed), rows.where(changed), ["dataset_id"], ["o_orderdate", "id"]).select(
        "dataset_id", "id", "target_column", "o_totalprice")


@query("insert_if_absent", """
WITH batch AS (SELECT 'customer#' || lpad(CAST(user_id * 20 AS VARCHAR), 9, '0') AS email, event_id FROM events)
SELECT email, min(event_id) AS event_id FROM batch
WHERE email NOT IN (SELECT lower(trim(c_name)) FROM customer) GROUP BY email""")
def insert_absent(t: Tables):
    batch = t.events.select(
        F.concat(F.lit("  CUSTOMER#"), F.lpad((F.col("user_id") * 20).cast("string"), 9, "0"), F.lit(" ")).alias("email"),
        "event_id")
    return insert_if_absent(t.customer.select(F.col("c_name").alias("email")), batch, "email", ["event_id"])


_TARGETS = ["o_orderstatus", "o_totalprice", "o_clerk", "", None, "o_orderpriority", "o_custkey"]
_CONFIGS_SQL = """
configs AS (
  SELECT o_orderkey AS dataset_id,
         [{targets}][o_orderkey % 7 + 1] AS target_column,
         CASE o_custkey % 3 WHEN 0 THEN ['o_orderkey', 'o_orderstatus'] WHEN 1 THEN ['o_custkey', 'o_orderdate', 'nothing'] ELSE [] END
           AS excluded_columns FROM orders)""".format(targets=", ".join("NULL" if n is None else f"'{n}'" for n in _TARGETS))
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def stored_configs(t: Tables):
    """One configuration of the orders table per order, sound and unsound ones."""
    targets = F.array(*[F.lit(n).cast("string") for n in _TARGETS])
    excluded = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("o_orderkey"), F.lit("o_orderstatus"))).when(
        F.col("o_custkey") % 3 == 1, F.array(F.lit("o_custkey"), F.lit("o_orderdate"), F.lit("nothing"))).otherwise(
        F.array().cast("array<string>"))
    return t.orders.select(F.col("o_orderkey").alias("dataset_id"),
                           F.element_at(targets, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("target_column"),
                           excluded.alias("excluded_columns"))


@query("config_check", f"""
WITH {_CONFIGS_SQL}, c AS (SELECT column_name FROM (DESCRIBE SELECT * FROM orders))
SELECT dataset_id, target_column,
       CASE WHEN target_column IS NULL OR target_column = '' THEN 'no target'
            WHEN target_column NOT IN (SELECT column_name FROM c) THEN 'unknown target'
            WHEN list_contains(excluded_columns, target_column) THEN 'target excluded' END AS reason
FROM configs""")
def config_check(t: Tables):
    return config_reasons(stored_configs(t), t.orders.columns).drop("excluded_columns")


@query("input_features", f"""
WITH {_CONFIGS_SQL},
left_over AS (
  SELECT dataset_id, list_filter({_ORDER_COLUMNS}, lambda n: n IS DISTINCT FROM target_column AND NOT list_contains(excluded_columns, n)) AS names
  FROM configs)
SELECT dataset_id, CAST(len(names) AS BIGINT) AS n_inputs, array_to_string(names[1:3], ',') AS first_inputs,
       CAST(greatest(len(names) - 3, 0) AS BIGINT) AS n_more FROM left_over""")
def input_features(t: Tables):
    return input_feature_table(stored_configs(t), t.orders.columns, 3).drop("target_column", "excluded_columns")


_GONE = """
WITH requests AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS user_id FROM lineitem),
gone AS (SELECT o_orderkey AS id FROM orders JOIN requests ON o_orderkey = id AND o_custkey = user_id)
"""


def _datasets_and_requests(t: Tables):
    datasets = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), "o_totalprice")
    return datasets, t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("user_id"))


@query("delete_owned", _GONE + """
SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT id FROM gone)""")
def delete_datasets(t: Tables):
    datasets, requests = _datasets_and_requests(t)
    return delete_owned(datasets, requests, ["id", "user_id"])


@query("delete_cascade", _GONE + """
SELECT l_orderkey AS dataset_id, l_linenumber, l_partkey, l_extendedprice FROM lineitem
WHERE l_orderkey NOT IN (SELECT id FROM gone)""")
def delete_cascade(t: Tables):
    datasets, requests = _datasets_and_requests(t)
    children = t.lineitem.select(F.col("l_orderkey").alias("dataset_id"), "l_linenumber", "l_partkey", "l_extendedprice")
    return delete_children(children, datasets, requests, ["id", "user_id"], "dataset_id")


@query("prediction_log", """
SELECT user_id, event_id AS dataset_id, 'set ' || event_id AS dataset_name, 'user ' || user_id AS user_name,
       event_type AS selected_model, props AS prediction_result,
       CASE WHEN event_type <> 'view' THEN value END AS confidence_score FROM events""")
def prediction_log(t: Tables):
    scored = t.events.withColumn("confidence", F.expr("CASE WHEN event_type <> 'view' THEN value END"))
    path = scratch_path(t.spark, "prediction-log")
    for late in (False, True):
        rows = scored.where((F.col("event_type") == "error") == late)
        prediction_rows(
            rows, F.col("user_id"), F.col("event_id"), F.concat(F.lit("set "), "event_id"),
            F.concat(F.lit("user "), "user_id"), F.col("event_type"), "props").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("split_roundtrip", """
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS k,
                  count(*) OVER () AS n FROM orders)
SELECT CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows,
       CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM r GROUP BY 1""")
def split_roundtrip(t: Tables):
    path = scratch_path(t.spark, "splits")
    rows = t.orders.select("o_orderkey", "o_totalprice")
    split_exact(rows, F.col("o_orderkey").cast("string")).write.partitionBy("split").parquet(path)
    return t.spark.read.parquet(path).groupBy("split").agg(
        F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))
