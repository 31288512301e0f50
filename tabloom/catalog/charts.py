"""Numbers behind the charts."""

from pyspark.sql import functions as F

from tabloom.catalog.profiles import _DOC_COLUMNS, _DOCS, _missing_sql, labelled_documents
from tabloom.catalog.registry import Tables, query
from tabloom.operators import charts

_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "discount", "l_tax", "same"]
_SOURCE = "(SELECT *, nullif(l_discount, 0) AS discount, 1.0::DOUBLE AS same FROM lineitem)"


def _rows(t: Tables):
    return t.lineitem.withColumn("discount", F.expr("nullif(l_discount, 0)")).withColumn("same", F.lit(1.0)).select(*_COLUMNS)


def _corr(a, b):
    if "same" in (a, b):
        return "CAST(max(NULL) AS DOUBLE)"
    return "max(1.0::DOUBLE)" if a == b else f"round(corr({a}, {b}), 6)"


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS r FROM {_SOURCE}" for a in _COLUMNS for b in _COLUMNS))
def corr_matrix(t: Tables):
    return charts.correlation_matrix(_rows(t)).withColumn("r", F.round("r", 6))


@query("missing_ranked", f"SELECT * FROM ({_missing_sql(_DOC_COLUMNS, _DOCS)}) WHERE n_missing > 0")
def missing_ranked(t: Tables):
    return charts.missing_ranked(labelled_documents(t))


@query("histogram20", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w
           FROM lineitem),
h AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS BIGINT), 19) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT g.bin, round(lo + g.bin * w, 6) AS lo, round(lo + (g.bin + 1) * w, 6) AS hi, coalesce(n, 0) AS n
FROM (SELECT unnest(range(20)) AS bin) g CROSS JOIN b LEFT JOIN h ON g.bin = h.bin""")
def histogram20(t: Tables):
    return charts.histogram(t.lineitem, "l_extendedprice").withColumns({n: F.round(n, 6) for n in ("lo", "hi")})


@query("target_counts", "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1")
def target_counts(t: Tables):
    return charts.value_counts(t.lineitem, "l_returnflag")


_FEATURES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "discount", "l_tax", "same"]


@query("feature_importance", " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, {'CAST(max(NULL) AS DOUBLE)' if n == 'same' else f'round(abs(corr({n}, l_extendedprice)), 6)'}
    AS importance FROM {_SOURCE}""" for n in _FEATURES))
def feature_importance(t: Tables):
    return charts.correlation_importance(_rows(t), "l_extendedprice").withColumn("importance", F.round("importance", 6))
