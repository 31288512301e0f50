"""Duplicates, number formats, missing cells, encoding, scaling, splitting."""

from pyspark.sql import functions as F

from tabloom.catalog.profiles import labelled_documents
from tabloom.catalog.registry import Tables, query
from tabloom.operators import clean, detect, encode, impute, quantiles, scale, split
from tabloom.functions.columns import normalise

_PRICE_TEXT = """concat('$', cast(cast(floor(o_totalprice / 1000) AS BIGINT) AS {s}), ',',
 lpad(cast(cast(floor(o_totalprice) AS BIGINT) % 1000 AS {s}), 3, '0'))"""
_SHARE_TEXT = """CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE concat(cast(o_orderkey % 89 AS {s}), '.5 %') END"""
_MIXED_TEXT = """CASE WHEN o_orderstatus = 'F' THEN 'code F' ELSE cast(o_custkey AS {s}) END"""


def _spark(text):
    return F.expr(text.format(s="STRING"))


def _duck(text):
    return text.format(s="VARCHAR")


def formatted_orders(t: Tables):
    return t.orders.select("o_orderkey", _spark(_PRICE_TEXT).alias("price"), _spark(_SHARE_TEXT).alias("share"),
                           _spark(_MIXED_TEXT).alias("mixed"), "o_orderpriority")


@query("dedup_after_drop", """
SELECT p_name, p_brand, p_type, count(*) AS copies, CAST(min(p_partkey) AS VARCHAR) AS first_key
FROM part GROUP BY ALL""")
def dedup_after_drop(t: Tables):
    kept = clean.drop_excluded(t.part, ["p_size", "p_retailprice", "no_such_column"], "p_type")
    return clean.distinct_rows(kept, ["p_partkey"], ignored=["p_partkey"]).withColumnsRenamed(
        {clean.COPIES: "copies", clean.ROW_KEY: "first_key"})


@query("dedup_report", """
SELECT count(*) AS n_before, count(DISTINCT (p_name, p_brand, p_type)) AS n_after,
       count(*) - count(DISTINCT (p_name, p_brand, p_type)) AS n_removed FROM part""")
def dedup_report(t: Tables):
    return clean.duplicate_report(clean.drop_excluded(t.part, ["p_partkey", "p_size", "p_retailprice"]))


@query("clean_numeric_format", f"""
SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price,
       CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 89 + 0.5::DOUBLE END AS share,
       {_duck(_MIXED_TEXT)} AS mixed, o_orderpriority FROM orders""")
def clean_numeric_format(t: Tables):
    return clean.clean_number_formats(formatted_orders(t))[0]


@query("clean_detect_rate", f"""
WITH f AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 10 <> 0) AS s, count(*) FILTER (o_orderstatus <> 'F') AS m
           FROM orders)
SELECT 'price' AS "column", n AS n_filled, n AS n_numbers, n AS n_integers, 1.0::DOUBLE AS rate, true AS is_number FROM f
UNION ALL SELECT 'share', n, s, 0, round(s / n, 6), s / n > 0.8 FROM f
UNION ALL SELECT 'mixed', n, m, m, round(m / n, 6), m / n > 0.8 FROM f
UNION ALL SELECT 'o_orderpriority', n, 0, 0, 0.0, false FROM f""")
def clean_detect_rate(t: Tables):
    return clean.number_rates(formatted_orders(t)).withColumn("rate", F.round("rate", 6))


@query("detect_problem_type", """
SELECT 'l_returnflag' AS "column", 'classification' AS problem_type
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN 'classification' ELSE 'regression' END FROM lineitem
UNION ALL SELECT 'line_or_null', 'regression'
UNION ALL SELECT 'l_suppkey', CASE WHEN count(DISTINCT l_suppkey) <= 10 THEN 'classification' ELSE 'regression' END FROM lineitem
UNION ALL SELECT 'l_quantity', 'regression'
UNION ALL SELECT 'is_open', CASE WHEN count(l_linestatus) = count(*) THEN 'regression' ELSE 'classification' END FROM lineitem
UNION ALL SELECT 'nothing', 'classification'""")
def detect_problem_type(t: Tables):
    rows = t.lineitem.select(
        "l_returnflag", "l_linenumber", F.expr("nullif(l_linenumber, 3)").alias("line_or_null"), "l_suppkey", "l_quantity",
        (F.col("l_linestatus") == "O").alias("is_open"), F.expr("nullif(l_tax, l_tax)").alias("nothing"))
    return detect.problem_types(rows, rows.columns)


def _fill(df, columns, strategy="auto"):
    return impute.apply_fills(df, impute.fit_fills(df, columns, strategy))


@query("missing_drop_cols", """
WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
gone AS (SELECT round(100.0 * (count(*) - count(quality)) / count(*), 1) > 50 AS quality,
                round(100.0 * (count(*) - count(toxic)) / count(*), 1) > 50 AS toxic FROM d)
SELECT doc_id, text, lang, source, n_chars,
       (SELECT concat_ws(',', CASE WHEN NOT quality THEN 'quality' END, CASE WHEN NOT toxic THEN 'toxic' END) FROM gone) AS kept
FROM d""")
def missing_drop_cols(t: Tables):
    filled = _fill(labelled_documents(t), ["text", "lang", "quality", "toxic"])
    kept = [n for n in ("quality", "toxic") if n in filled.columns]
    return filled.select("doc_id", "text", "lang", "source", "n_chars", F.lit(",".join(kept)).alias("kept"))


@query("missing_drop_cols_any", """
SELECT o_orderkey, o_orderpriority,
       (SELECT CASE WHEN count(nullif(o_custkey, 1)) = count(*) THEN 'o_custkey' ELSE '' END FROM orders) AS kept FROM orders""")
def missing_drop_cols_any(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.expr("nullif(o_custkey, 1)").alias("o_custkey"))
    filled = _fill(rows, ["o_orderpriority", "o_custkey"], "drop")
    return filled.select("o_orderkey", "o_orderpriority",
                         F.lit("o_custkey" if "o_custkey" in filled.columns else "").alias("kept"))


@query("missing_drop_rows", "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def missing_drop_rows(t: Tables):
    return impute.drop_incomplete_rows(labelled_documents(t).select("doc_id", "lang", "n_chars", "quality", "toxic"))


@query("impute_median", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
  coalesce(nullif(l_discount, 0), (SELECT median(nullif(l_discount, 0)) FROM lineitem)) AS l_discount,
  coalesce(nullif(l_quantity, 7), (SELECT median(nullif(l_quantity, 7)) FROM lineitem)) AS l_quantity
FROM lineitem""")
def impute_median(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.expr("nullif(l_discount, 0)").alias("l_discount"),
        F.expr("nullif(l_quantity, 7)").alias("l_quantity"))
    return _fill(rows, ["l_extendedprice", "l_discount", "l_quantity"])


_MEDIANS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "zeros"]
_ZEROS = "CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_extendedprice END"


@query("median_distributed", " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", round_even(median({n}), 4) AS median
    FROM (SELECT *, {_ZEROS} AS zeros FROM lineitem)""" for n in _MEDIANS))
def median_distributed(t: Tables):
    found = quantiles.exact_medians(t.lineitem.withColumn("zeros", F.expr(_ZEROS)), _MEDIANS)
    rows = t.spark.createDataFrame(list(found.items()), "column string, median double")
    return rows.withColumn("median", F.bround("median", 4))


_MODE = """(SELECT {c} FROM orders WHERE {c} <> '{gap}' GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


@query("impute_mode", f"""
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), {_MODE.format(c='o_orderpriority', gap='5-LOW')}) AS o_orderpriority,
       coalesce(nullif(o_orderstatus, 'P'), {_MODE.format(c='o_orderstatus', gap='P')}) AS o_orderstatus,
       'Unknown' AS nothing FROM orders""")
def impute_mode(t: Tables):
    rows = t.orders.select(
        "o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"),
        F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"),
        F.expr("nullif(o_orderstatus, o_orderstatus)").alias("nothing"))
    return _fill(rows, ["o_orderpriority", "o_orderstatus", "nothing"], "median")


@query("drop_null_target", "SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def drop_null_target(t: Tables):
    return impute.drop_null_target(labelled_documents(t).select("doc_id", "lang", "n_chars", "quality"), "quality")


@query("high_card_drop", """
SELECT o_orderkey, o_custkey, o_totalprice,
       (SELECT concat_ws(',', CASE WHEN count(DISTINCT o_orderdate) <= 15 THEN 'o_orderdate' END,
                              CASE WHEN count(DISTINCT o_orderpriority) <= 15 THEN 'o_orderpriority' END) FROM orders) AS kept
FROM orders""")
def high_card_drop(t: Tables):
    rows = normalise(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"))
    left = rows.drop(*encode.fit_levels(rows).dropped)
    kept = [n for n in ("o_orderdate", "o_orderpriority") if n in left.columns]
    return left.select("o_orderkey", "o_custkey", "o_totalprice", F.lit(",".join(kept)).alias("kept"))


@query("encode_binary", """
SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::BIGINT AS l_linestatus FROM lineitem""")
def encode_binary(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus")
    return encode.apply_levels(rows, encode.fit_levels(rows))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _indicators(column, levels):
    return ", ".join(f"""({column} = '{v}')::BIGINT AS "{column}_{v}" """ for v in levels)


@query("encode_onehot", f"""
SELECT o_orderkey, {_indicators('o_orderpriority', _PRIORITIES)}, {_indicators('o_orderstatus', ['F', 'O', 'P'])} FROM orders""")
def encode_onehot(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.apply_levels(rows, encode.fit_levels(rows))


@query("encode_target", """
SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS label FROM part""")
def encode_target(t: Tables):
    return encode.encode_target(t.part.select("p_partkey", "p_brand"), "p_brand")


@query("encode_target_many", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS label FROM customer""")
def encode_target_many(t: Tables):
    rows = t.customer.select("c_custkey", "c_name")
    classes, _ = encode.class_table(rows, "c_name", small=100)
    return encode.encode_target(rows, "c_name", classes=classes).drop("c_name")


_SCALED = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("scale_standard", f"""
SELECT l_orderkey, l_linenumber, {", ".join(
    f"round_even(({n} - avg({n}) OVER ()) / coalesce(nullif(stddev_pop({n}) OVER (), 0), 1), 4) AS {n}" for n in _SCALED)},
    0.0::DOUBLE AS same FROM lineitem""")
def scale_standard(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *_SCALED, F.lit(3.0).alias("same"))
    scaled = scale.apply_scaler(rows, scale.fit_scaler(rows, _SCALED + ["same"]))
    return scaled.select("l_orderkey", "l_linenumber", *[F.bround(n, 4).alias(n) for n in _SCALED], "same")


@query("split_exact", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= ceil(count(*) OVER () * 0.25)
       THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_exact(t: Tables):
    return split.split_exact(t.orders.select("o_orderkey"), F.col("o_orderkey").cast("string"), 0.25)
