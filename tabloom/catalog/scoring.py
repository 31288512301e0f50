"""Input check, stored scaler, scoring, confidence, decoding."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.catalog.modelling import NEIGHBOURS_SQL, document_quality, neighbours, vector_table
from tabloom.catalog.registry import Tables, query
from tabloom.operators import encode, knn, score
from tabloom.operators.clean import ROW_KEY
from tabloom.operators.models import Fitted, KnnModel
from tabloom.operators.scale import apply_scaler, fit_scaler
from tabloom.operators.split import TEST, TRAIN, split_exact
from tabloom.plans import score_table, train_suite

_AMOUNT = """CASE WHEN o_orderpriority = '1-URGENT' THEN ' ' WHEN o_orderpriority = '2-HIGH' THEN 'about 5'
 WHEN o_orderpriority = '3-MEDIUM' THEN ' 1e3 ' ELSE concat(cast(o_custkey AS {s}), '.25') END"""
_KEY = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE cast(o_custkey AS {s}) END"


@query("score_validate", """
SELECT o_orderkey,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1000.0 WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN o_custkey + 0.25 END::DOUBLE AS amount,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey END::DOUBLE AS customer,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'amount: missing' WHEN o_orderpriority = '2-HIGH' THEN 'amount: not numeric'
       WHEN o_orderstatus = 'P' THEN 'customer: missing' END AS reason
FROM orders""")
def score_validate(t: Tables):
    rows = t.orders.select("o_orderkey", F.expr(_AMOUNT.format(s="STRING")).alias("amount"),
                           F.expr(_KEY.format(s="STRING")).alias("customer"))
    return score.validate_inputs(rows, ["amount", "customer"])


@query("score_scale", """
WITH r AS (SELECT o_orderkey, o_totalprice, o_custkey,
             row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= ceil(count(*) OVER () * 0.2) AS is_test FROM orders),
s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(o_custkey) AS m2, stddev_pop(o_custkey) AS s2
      FROM r WHERE NOT is_test)
SELECT o_orderkey, round_even((o_totalprice - m1) / s1, 4) AS o_totalprice, round_even((o_custkey - m2) / s2, 4) AS o_custkey
FROM r, s""")
def score_scale(t: Tables):
    rows = split_exact(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), F.col("o_orderkey").cast("string"))
    stored = fit_scaler(rows.where(F.col("split") == TRAIN), ["o_totalprice", "o_custkey"])
    return apply_scaler(rows, stored).select(
        "o_orderkey", *[F.bround(n, 4).alias(n) for n in ("o_totalprice", "o_custkey")])


@query("score_batch", """
SELECT CAST(d.doc_id AS VARCHAR) AS row_key,
  CASE WHEN doc_id % 7 = 1 THEN 'n_chars: not numeric' WHEN doc_id % 11 = 3 THEN 'toxic: not numeric'
       WHEN doc_id % 7 = 2 THEN 'n_chars: missing' WHEN toxic IS NULL THEN 'toxic: missing' END AS reason,
  reason IS NULL AS has_prediction, reason IS NULL AS sums_to_100
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def score_batch(t: Tables):
    """Every document, with unreadable and missing cells put in; the unlabelled ones have no ``toxic``."""
    prep = document_quality(t)
    trained = train_suite(prep, ["logistic_regression"])
    rows = t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id", "left").select(
        "doc_id", "lang",
        F.expr("CASE doc_id % 7 WHEN 1 THEN 'many' WHEN 2 THEN ' ' ELSE cast(n_chars AS STRING) END").alias("n_chars"),
        F.expr("CASE WHEN doc_id % 11 = 3 THEN 'no' ELSE cast(toxic AS STRING) END").alias("toxic"))
    scored = score_table(rows, prep.state, trained.best, prep.classes, key=["doc_id"])
    total = F.aggregate("percentages", F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        F.col(ROW_KEY).alias("row_key"), "reason",
        (F.col("label").isin("0", "1") & F.col("prediction").isNotNull()).alias("has_prediction"),
        (F.coalesce(F.abs(total - 100) <= 0.1, F.lit(False)) & F.col("confidence").between(0.5, 1)).alias("sums_to_100")
    ).withColumns({n: F.coalesce(n, F.lit(False)) for n in ("has_prediction", "sums_to_100")})


@query("score_confidence", f"WITH {NEIGHBOURS_SQL} SELECT qid AS vec_id, prediction, round(votes / 3, 6) AS confidence FROM best")
def score_confidence(t: Tables):
    return knn.knn_predict(neighbours(t)).select(
        F.col("qid").alias("vec_id"), "prediction", F.round("confidence", 6).alias("confidence"))


@query("decode_label", """
SELECT l_orderkey, l_linenumber, l_partkey, ['A', 'N', 'R'][l_linenumber % 4 + 1] AS decoded FROM lineitem""")
def decode_label(t: Tables):
    classes, _ = encode.class_table(t.lineitem, "l_returnflag")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             (F.col("l_linenumber") % 4).cast("double").alias("prediction"))
    return encode.decode_labels(rows, classes, "prediction", "decoded").drop("prediction")


@query("class_probabilities", f"""
WITH {NEIGHBOURS_SQL}
SELECT q.qid AS vec_id, 'class ' || c.label AS class_label, round_even(coalesce(votes, 0) / 3 * 100, 1) AS percentage
FROM (SELECT DISTINCT qid FROM near) q CROSS JOIN (SELECT DISTINCT label FROM embeddings) c
LEFT JOIN votes ON votes.qid = q.qid AND votes.label = c.label""")
def class_probabilities(t: Tables):
    rows = vector_table(t).withColumn("class_name", F.concat(F.lit("class "), F.col("label").cast("string")))
    classes, labels = encode.class_table(rows, "class_name")
    rows = encode.encode_target(rows.drop("label"), "class_name", "label", classes)
    train = rows.where(F.col("split") == TRAIN).select(F.col("vec_id").alias("nid"), "label", "vec")
    asked = rows.where(F.col("split") == TEST).select("vec_id", array_to_vector("vec").alias("features"))
    shares = Fitted("knn", KnnModel(train, len(labels))).class_shares(asked, "vec_id")
    return score.class_percentages(shares, classes, "vec_id")
