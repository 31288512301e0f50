"""The model families, each trained on a prepared table."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import Tables, query
from tabloom.operators import knn, models
from tabloom.operators.split import TEST, TRAIN, split_exact
from tabloom.plans import PrepConfig, prepare, train_suite


def part_prices(t: Tables):
    """Regression: retail price from key, size and type (brand is too wide)."""
    return prepare(t.part, PrepConfig(target="p_retailprice"))


def document_quality(t: Tables):
    """Classification: quality from language, length and toxicity."""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "n_chars", "toxic", "quality")
    return prepare(rows, PrepConfig(target="quality", key=("doc_id",)))


def vector_table(t: Tables):
    """Vectors with their class, split by id."""
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long"))
    return split_exact(rows, F.col("vec_id").cast("string"))


def _scores(prep, name):
    return train_suite(prep, [name]).metrics.drop("model_order")


@query("linreg_coef", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem""")
def linreg_coef(t: Tables):
    rows = models.assemble(t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label")), ["l_quantity"])
    fitted = models.fit_model("linear_regression", rows, rows.count(), 1).model
    return t.spark.createDataFrame(
        [(float(fitted.coefficients[0]), float(fitted.intercept))], "slope double, intercept double"
    ).select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


# With the levels of one column as features, the best a model can do is known: the mean, or the majority, of each level.
_TYPE = "CASE WHEN o_orderpriority < '3' THEN 'high' WHEN o_orderpriority < '4' THEN 'middle' ELSE 'low' END"
_PRICE = f"(o_totalprice + CASE {_TYPE} WHEN 'high' THEN 100000 WHEN 'middle' THEN 400000 ELSE 0 END)"
_LATE = f"(CASE WHEN o_orderkey % 10 < CASE {_TYPE} WHEN 'high' THEN 8 WHEN 'middle' THEN 1 ELSE 6 END THEN 1 ELSE 0 END)"


def levels_table(table, key: str, level: str, target: str):
    """Two indicator columns for three levels, and the target, split by key."""
    rows = table.select(key, F.expr(level).alias("level"), F.expr(target).cast("double").alias("label"))
    rows = rows.withColumns({n: (F.col("level") == n).cast("double") for n in ("high", "middle")})
    return split_exact(rows, F.col(key).cast("string"))


def level_predictions(levels, name: str, n_classes: int = 0):
    """What the model says about the rows it has not seen, per level."""
    rows = models.assemble(levels, ["high", "middle"])
    train = rows.where(F.col("split") == TRAIN)
    fitted = models.fit_model(name, train, train.count(), 2, n_classes, trees=20)
    return fitted.transform(rows.where(F.col("split") == TEST)).groupBy("level").agg(
        F.min("prediction").alias("least"), F.max("prediction").alias("most"), F.count("*").alias("n_rows"))


# The kernel model's training takes many passes: a smaller table, of parts.
_PART_LEVEL = "CASE WHEN p_size % 3 = 0 THEN 'high' WHEN p_size % 3 = 1 THEN 'middle' ELSE 'low' END"
_PART_GOOD = f"(CASE WHEN p_partkey % 10 < CASE {_PART_LEVEL} WHEN 'high' THEN 8 WHEN 'middle' THEN 1 ELSE 6 END THEN 1 ELSE 0 END)"

_LEVELS_SQL = """
WITH r AS (SELECT {level} AS level, CAST({target} AS DOUBLE) AS label,
             row_number() OVER (ORDER BY md5('42|' || {key})) <= ceil(count(*) OVER () * 0.2) AS is_test FROM {table}),
best AS (SELECT level, {best} AS prediction FROM r WHERE NOT is_test GROUP BY level)
SELECT level, prediction AS least, prediction AS most, count(*) AS n_rows
FROM r JOIN best USING (level) WHERE is_test GROUP BY level, prediction"""
_ORDERS = {"key": "o_orderkey", "table": "orders", "level": _TYPE}
_MEANS = _LEVELS_SQL.format(target=_PRICE, best="round(avg(label), 2)", **_ORDERS)
_MAJORITIES = _LEVELS_SQL.format(target=_LATE, best="round(avg(label))", **_ORDERS)


def _register_levels(model: str, target: str, sql: str, n_classes: int):
    @query(f"levels_{model}", sql)
    def build(t: Tables):
        return level_predictions(levels_table(t.orders, "o_orderkey", _TYPE, target), model, n_classes).withColumns(
            {n: F.round(n, 2) for n in ("least", "most")})


for _model in ("linear_regression", "decision_tree_regressor", "gradient_boosting_regressor"):
    _register_levels(_model, _PRICE, _MEANS, 0)
for _model in ("logistic_regression", "decision_tree", "random_forest"):
    _register_levels(_model, _LATE, _MAJORITIES, 2)


# All levels of a column and of a coarser one: the coarser adds nothing, and each column's indicators sum to one.
@query("levels_linear_collinear", _LEVELS_SQL.format(
    target="o_totalprice", best="round(avg(label), 2)", key="o_orderkey", table="orders", level="o_orderpriority"))
def levels_linear_collinear(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("level"), F.expr(_TYPE).alias("coarse"),
                           F.col("o_totalprice").alias("label"))
    rows = split_exact(rows, F.col("o_orderkey").cast("string"))
    levels = [(column, r[0]) for column in ("level", "coarse") for r in rows.select(column).distinct().orderBy(column).collect()]
    rows = rows.withColumns({f"is_{column}_{value}": (F.col(column) == value).cast("double") for column, value in levels})
    rows = models.assemble(rows, [f"is_{column}_{value}" for column, value in levels])
    fitted = models.fit_model("linear_regression", rows.where(F.col("split") == TRAIN), rows.count(), len(levels))
    return fitted.transform(rows.where(F.col("split") == TEST)).groupBy("level").agg(
        F.round(F.min("prediction"), 2).alias("least"), F.round(F.max("prediction"), 2).alias("most"), F.count("*").alias("n_rows"))


@query("levels_svm", _LEVELS_SQL.format(
    target=_PART_GOOD, best="round(avg(label))", key="p_partkey", table="part", level=_PART_LEVEL))
def levels_svm(t: Tables):
    return level_predictions(levels_table(t.part, "p_partkey", _PART_LEVEL, _PART_GOOD), "svm", 2)


@query("levels_random_forest_regressor", f"""
WITH r AS (SELECT {_TYPE} AS level, CAST({_PRICE} AS DOUBLE) AS label,
             row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= ceil(count(*) OVER () * 0.2) AS is_test FROM orders),
best AS (SELECT level, avg(label) AS mean, stddev_pop(label) / sqrt(count(*)) AS error FROM r WHERE NOT is_test GROUP BY level)
SELECT level, count(*) AS n_rows, max(error) < 0.2 * max(mean) AS near_mean FROM r JOIN best USING (level) WHERE is_test GROUP BY level""")
def levels_random_forest_regressor(t: Tables):
    """Bootstrapped trees come near the mean of a level, by its standard error."""
    levels = levels_table(t.orders, "o_orderkey", _TYPE, _PRICE)
    found = level_predictions(levels, "random_forest_regressor")
    means = levels.where(F.col("split") == TRAIN).groupBy("level").agg(
        F.avg("label").alias("mean"), (F.stddev_pop("label") / F.sqrt(F.count("*"))).alias("error"))
    off = F.greatest(F.abs(F.col("least") - F.col("mean")), F.abs(F.col("most") - F.col("mean")))
    return found.join(means, "level").select("level", "n_rows", (off <= F.col("error")).alias("near_mean"))


@query("linreg")
def linreg(t: Tables):
    return _scores(part_prices(t), "linear_regression")


@query("dtree_reg")
def dtree_reg(t: Tables):
    return _scores(part_prices(t), "decision_tree_regressor")


@query("rf_reg")
def rf_reg(t: Tables):
    return _scores(part_prices(t), "random_forest_regressor")


@query("gbt_reg")
def gbt_reg(t: Tables):
    return _scores(part_prices(t), "gradient_boosting_regressor")


@query("logreg")
def logreg(t: Tables):
    return _scores(document_quality(t), "logistic_regression")


@query("dtree_cls")
def dtree_cls(t: Tables):
    return _scores(document_quality(t), "decision_tree")


@query("rf_cls")
def rf_cls(t: Tables):
    return _scores(document_quality(t), "random_forest")


@query("svm_rff")
def svm_rff(t: Tables):
    return _scores(document_quality(t), "svm")


@query("feature_importance_model")
def feature_importance_model(t: Tables):
    return train_suite(part_prices(t), ["decision_tree_regressor"]).importances(t.spark)


_SIZES = """
WITH r AS (SELECT CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS label, p_size AS size, p_partkey * 7919 % 97 AS noise FROM part),
f AS (SELECT 'size' AS feature, abs(corr(label, size)) AS strength FROM r UNION ALL SELECT 'noise', abs(corr(label, noise)) FROM r)
SELECT feature, strength = max(strength) OVER () AS is_greatest, strength < 0.2 AS is_nothing FROM f"""


def _register_exchange(name: str):
    @query(f"importance_{name}", _SIZES)
    def build(t: Tables):
        """Models without importances of their own: the only column that decides, and one that does not."""
        rows = t.part.select("p_partkey", (F.col("p_size") > 25).cast("double").alias("label"), (F.col("p_size") / 10).alias("size"),
                             (F.col("p_partkey") * 7919 % 97 / 1000).alias("noise"))
        rows = models.assemble(split_exact(rows, F.col("p_partkey").cast("string")), ["size", "noise"])
        train = rows.where(F.col("split") == TRAIN)
        fitted = models.fit_model(name, train, train.count(), 2, 2, "p_partkey")
        found = models.permutation_importances(fitted, rows.where(F.col("split") == TEST), ["size", "noise"], "classification")
        most = found[0][1]
        return t.spark.createDataFrame([(f, v == most, v < 0.02) for f, v in found], "feature string, is_greatest boolean, is_nothing boolean")


for _model in ("knn", "svm"):
    _register_exchange(_model)


NEIGHBOURS_SQL = """
v AS (
  SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS e,
    row_number() OVER (ORDER BY md5('42|' || vec_id)) <= ceil(count(*) OVER () * 0.2) AS is_test FROM embeddings),
d AS (
  SELECT q.vec_id AS qid, t.vec_id AS nid, t.label,
    list_sum(list_transform(list_zip(q.e, t.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance2
  FROM v q JOIN v t ON q.is_test AND NOT t.is_test),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance2, nid) <= 3),
votes AS (SELECT qid, label, count(*) AS votes FROM near GROUP BY 1, 2),
best AS (SELECT qid, label AS prediction, votes FROM votes
         QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) = 1)"""


def neighbours(t: Tables):
    rows = vector_table(t)
    train = rows.where(F.col("split") == TRAIN).select(F.col("vec_id").alias("nid"), "label", "vec")
    asked = rows.where(F.col("split") == TEST).select(F.col("vec_id").alias("qid"), "vec")
    return knn.knn_join(train, asked)


@query("knn_neighbours", f"""
WITH {NEIGHBOURS_SQL}
SELECT qid, nid, label, round(distance2, 8) AS distance2,
       row_number() OVER (PARTITION BY qid ORDER BY near.distance2, nid) AS rank FROM near""")
def knn_neighbours(t: Tables):
    return neighbours(t).select("qid", "nid", "label", F.round("distance2", 8).alias("distance2"),
                                F.col("rank").cast("long").alias("rank"))


@query("knn_classify", f"WITH {NEIGHBOURS_SQL} SELECT qid AS vec_id, prediction FROM best")
def knn_classify(t: Tables):
    return knn.knn_predict(neighbours(t)).select(F.col("qid").alias("vec_id"), "prediction")


@query("train_suite_classification")
def train_suite_classification(t: Tables):
    return train_suite(document_quality(t)).leaderboard()


@query("train_suite_regression")
def train_suite_regression(t: Tables):
    return train_suite(part_prices(t)).leaderboard()

