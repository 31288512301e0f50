"""Shape, types, missing cells, statistics, frequencies."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import Tables, query
from tabloom.operators import profile
from tabloom.operators.rollup import owner_lookup

LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def labelled_documents(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left")


def _missing_sql(columns, source):
    return " UNION ALL ".join(f"""
SELECT '{n}' AS "column", count(*) - count({n}) AS n_missing,
       round_even((count(*) - count({n})) * 100.0 / count(*), 1) AS missing_pct FROM {source}""" for n in columns)


_DOCS = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
_DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query("profile_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def profile_shape(t: Tables):
    return profile.shape(t.lineitem)


@query("preview_top10", """
SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 10""")
def preview_top10(t: Tables):
    return profile.preview(t.orders, ["o_orderkey"]).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


_TYPES = """
SELECT column_name AS "column",
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'timestamp' END AS dtype,
       column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'BOOLEAN') AS is_numeric
FROM (DESCRIBE SELECT *, l_linestatus = 'O' AS is_open FROM lineitem)"""


def _with_boolean(lines):
    return lines.withColumn("is_open", F.col("l_linestatus") == "O")


def _types(t: Tables):
    return profile.column_types(_with_boolean(t.lineitem)).withColumn(
        "dtype", F.when(F.col("dtype").startswith("timestamp"), "timestamp").otherwise(F.col("dtype")))


@query("profile_dtypes", _TYPES)
def profile_dtypes(t: Tables):
    return _types(t).drop("position")


@query("profile_dtype_summary", f"""
SELECT count(DISTINCT dtype) AS n_dtypes, count(*) FILTER (is_numeric) AS n_numeric,
       count(*) FILTER (NOT is_numeric) AS n_categorical FROM ({_TYPES})""")
def profile_dtype_summary(t: Tables):
    return profile.type_summary(_types(t))


@query("profile_missing", _missing_sql(_DOC_COLUMNS, _DOCS))
def profile_missing(t: Tables):
    return profile.missing(labelled_documents(t))


@query("missing_total", f"""
SELECT sum(n)::BIGINT AS total_missing FROM (
SELECT count(*) - count(quality) + count(*) - count(toxic) AS n FROM {_DOCS})""")
def missing_total(t: Tables):
    return profile.missing_total(labelled_documents(t))


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "is_open"]
_VALUES = {"l_discount": "nullif(l_discount, 0)", "is_open": "(l_linestatus = 'O')::INTEGER"}


@query("profile_numeric", " UNION ALL ".join(f"""
SELECT '{n}' AS "column", count(*) - count(v) AS n_missing,
       round_even((count(*) - count(v)) * 100.0 / count(*), 1) AS missing_pct, count(DISTINCT v) AS n_distinct,
       round_even(avg(v), 4) AS mean, round_even(stddev_samp(v), 4) AS std,
       round_even(min(v)::DOUBLE, 4) AS min, round_even(max(v)::DOUBLE, 4) AS max
FROM (SELECT {_VALUES.get(n, n)} AS v FROM lineitem)""" for n in _NUMERIC))
def profile_numeric(t: Tables):
    return profile.numeric_statistics(_with_boolean(t.lineitem).withColumn("l_discount", F.expr("nullif(l_discount, 0)")))


_TEXT = ["text", "lang", "source"]


@query("profile_top3", f"""
WITH f AS ({" UNION ALL ".join(f"SELECT '{n}' AS c, {n} AS value, count(*) AS n FROM documents GROUP BY {n}" for n in _TEXT)})
SELECT c AS "column", value, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, value) AS rank FROM f
QUALIFY rank <= 3""")
def profile_top3(t: Tables):
    return profile.top_values(t.documents)


@query("profile_text", " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(DISTINCT {n}) AS n_distinct, count({n}) AS n_filled FROM documents""" for n in _TEXT))
def profile_text(t: Tables):
    return profile.text_statistics(t.documents)


@query("profile_search", f"""SELECT * FROM ({_missing_sql(LINEITEM_COLUMNS, 'lineitem')}) WHERE lower("column") LIKE '%key%'""")
def profile_search(t: Tables):
    return profile.search_columns(profile.missing(t.lineitem), " KEY")


@query("owner_lookup", """
SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)""")
def owner_lookup_query(t: Tables):
    datasets = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), "o_totalprice")
    requests = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("user_id"))
    return owner_lookup(datasets, requests, ["id", "user_id"])
