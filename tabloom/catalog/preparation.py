"""The whole preparation on a denormalised orders table."""

from pyspark.sql import functions as F

from tabloom.catalog.cleaning import _PRICE_TEXT, _PRIORITIES, _SEGMENTS, _duck, _spark
from tabloom.catalog.registry import Tables, query
from tabloom.operators.clean import ROW_KEY
from tabloom.plans import PrepConfig, prepare
from tabloom.plans.state import PrepState
from tabloom.session import scratch_path

CONFIG = PrepConfig(target="o_orderstatus", key=("o_orderkey",), excluded=("c_name",))


def order_dataset(t: Tables):
    """Formatted prices, missing cells of three kinds, wide and narrow categories."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", _spark(_PRICE_TEXT).alias("price"), "o_orderstatus",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"), "o_orderdate",
        F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.expr("CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END").alias("debt"), "c_nationkey",
        F.expr("CASE WHEN c_nationkey >= 20 THEN c_nationkey END").alias("rare"), "c_name")


def prepared(t: Tables):
    return prepare(order_dataset(t), CONFIG)


_SOURCE = f"""
src AS (
  SELECT o_orderkey, CAST(replace(replace({_duck(_PRICE_TEXT)}, '$', ''), ',', '') AS BIGINT) AS price, o_orderstatus,
         nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
         c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS debt, c_nationkey,
         CASE WHEN c_nationkey >= 20 THEN c_nationkey END AS rare, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_FILLED = f"""
filled AS (
  SELECT o_orderkey, price, coalesce(balance, (SELECT median(balance) FROM src)) AS balance,
         (debt = 'Y')::BIGINT AS debt, c_nationkey, segment, o_orderstatus,
         coalesce(priority, (SELECT priority FROM src WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
           AS priority FROM src)"""

_ENCODED = ["price", "balance", "debt", "c_nationkey"]
_DUMMIES = [("priority", v) for v in _PRIORITIES[:4]] + [("segment", v) for v in _SEGMENTS]


def _z(expression, name):
    return (f'round_even(({expression} - avg({expression}) OVER ()) / '
            f'coalesce(nullif(stddev_pop({expression}) OVER (), 0), 1), 4) AS "{name}"')


_E2E = f"""
WITH {_SOURCE}, {_FILLED}
SELECT CAST(o_orderkey AS VARCHAR) AS row_key,
  {", ".join(_z(n, n) for n in _ENCODED)},
  {", ".join(_z(f"({c} = '{v}')::BIGINT", f"{c}_{v}") for c, v in _DUMMIES)},
  o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::BIGINT AS label,
  CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= ceil(count(*) OVER () * 0.2)
       THEN 'test' ELSE 'train' END AS split
FROM filled"""


def rounded(result):
    numbers = [F.bround(F.col(f"`{n}`"), 4).alias(n) for n in result.state.features]
    return result.data.select(F.col(ROW_KEY).alias("row_key"), *numbers, "o_orderstatus", "label", "split")


@query("prepare_end_to_end", _E2E)
def prepare_end_to_end(t: Tables):
    return rounded(prepared(t))


def _line(step, column, action, affected, source="facts"):
    col = "NULL" if column is None else f"'{column}'"
    return f"SELECT '{step}', {col}, '{action}', CAST({affected} AS BIGINT) FROM {source}"


@query("prep_summary", f"""
WITH {_SOURCE}, facts AS (
  SELECT count(*) AS n, count(*) - count(rare) AS rare, count(*) - count(priority) AS prio,
         count(*) - count(balance) AS bal FROM src)
SELECT 'load' AS step, CAST(NULL AS VARCHAR) AS "column", 'read' AS action, n AS n_affected FROM facts
UNION ALL {" UNION ALL ".join([
    _line("exclude", "c_name", "dropped", "NULL"), _line("deduplicate", None, "removed", "0"),
    _line("number_format", "price", "long", "n"), _line("problem_type", "o_orderstatus", "classification", "NULL"),
    _line("missing", "rare", "dropped", "rare"), _line("missing", "priority", "mode", "prio"),
    _line("missing", "balance", "median", "bal"), _line("encode", "priority", "one-hot", "4"),
    _line("encode", "segment", "one-hot", "5"), _line("encode", "debt", "label", "2"),
    _line("encode", "o_orderdate", "dropped", "NULL"), _line("encode", "o_orderstatus", "label (target)", "3"),
    _line("split", None, "train/test", "n"),
    *[_line("scale", n, "standard", "NULL") for n in _ENCODED + [f"{c}_{v}" for c, v in _DUMMIES]]])}""")
def prep_summary(t: Tables):
    return prepared(t).summary(t.spark).select("step", "column", "action", "n_affected")


@query("state_roundtrip", f"""
WITH {_SOURCE}, {_FILLED}
SELECT 'class' AS kind, o_orderstatus AS name, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS value
FROM (SELECT DISTINCT o_orderstatus FROM filled)
UNION ALL {" UNION ALL ".join(f"SELECT 'mean', '{n}', round(avg({n}), 4) FROM filled" for n in _ENCODED)}
UNION ALL SELECT 'fill', 'priority',
  (SELECT count(*) FROM src WHERE priority = (SELECT priority FROM src WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
UNION ALL SELECT 'split', split, count(*) FROM (
  SELECT CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= ceil(count(*) OVER () * 0.2)
              THEN 'test' ELSE 'train' END AS split FROM filled) GROUP BY 1, 2""")
def state_roundtrip(t: Tables):
    """What was learned, after it was saved and loaded again: classes, means, a fill (by how often it occurs), and the splits."""
    path = scratch_path(t.spark, "prepared")
    prepared(t).save(path)
    state = PrepState.load(t.spark, f"{path}/state")
    classes = t.spark.read.parquet(f"{path}/classes").select(
        F.lit("class").alias("kind"), F.col("class_label").alias("name"), F.col("class_index").cast("double").alias("value"))
    means = t.spark.createDataFrame(
        [("mean", n, float(state.scaler[n][0])) for n in _ENCODED], "kind string, name string, value double")
    fill = order_dataset(t).where(F.col("priority") == state.fills.values["priority"]).agg(
        F.lit("fill").alias("kind"), F.lit("priority").alias("name"), F.count("*").cast("double").alias("value"))
    splits = t.spark.read.parquet(f"{path}/rows").groupBy("split").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("split").alias("kind"), F.col("split").alias("name"), "value")
    out = classes.unionByName(means.withColumn("value", F.round("value", 4))).unionByName(fill)
    return out.unionByName(splits)


def copied_orders(t: Tables):
    """Orders by three narrow columns, every third one twice: copies, and rows that differ in the key only."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 40).alias("group_no"))
    return rows.unionByName(rows.where("o_orderkey % 3 = 0"))


_COPIED = """
src AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey % 40 AS group_no FROM orders),
twice AS (SELECT * FROM src UNION ALL SELECT * FROM src WHERE o_orderkey % 3 = 0)"""
_LABELLED = """
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus,
       CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= ceil(count(*) OVER () * 0.2)
            THEN 'test' ELSE 'train' END AS split, (SELECT count(*) FROM twice) - count(*) OVER () AS n_copies
FROM once"""


def _kept_rows(t: Tables, excluded: tuple[str, ...]):
    prep = prepare(copied_orders(t), PrepConfig(target="o_orderstatus", key=("o_orderkey",), excluded=excluded))
    return prep.data.select(F.col(ROW_KEY).alias("row_key"), "o_orderstatus", "split",
                            F.lit(prep.facts["n_copies"]).cast("long").alias("n_copies"))


@query("prepare_with_duplicates", f"WITH {_COPIED}, once AS (SELECT DISTINCT * FROM twice) {_LABELLED}")
def prepare_with_duplicates(t: Tables):
    return _kept_rows(t, ())


@query("prepare_key_excluded", f"""WITH {_COPIED}, once AS (
SELECT min(o_orderkey) AS o_orderkey, o_orderstatus, o_orderpriority, group_no FROM twice GROUP BY 2, 3, 4) {_LABELLED}""")
def prepare_key_excluded(t: Tables):
    return _kept_rows(t, ("o_orderkey",))
