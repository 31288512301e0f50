"""Trees finished in tasks, and least squares, against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import forest, linear
from tabloom.operators.models import FORESTS, Fitted, fit_model, reaches_depth


def table(spark, x, y, parts=5):
    rows = [(v.tolist(), float(t)) for v, t in zip(x, y)]
    return spark.createDataFrame(rows, "v array<double>, label double").repartition(parts).select(array_to_vector("v").alias("features"), "label")


def plain_tree(x, y, n_classes):
    """One node after the other, every threshold tried."""
    def impurity_sum(rows):
        t = (y[rows][:, None] == np.arange(n_classes)).astype(float) if n_classes else y[rows][:, None]
        return float((t.sum(axis=0) ** 2).sum() / len(rows))

    def build(rows):
        leaf = np.bincount(y[rows].astype(int), minlength=n_classes) / len(rows) if n_classes else np.array([y[rows].mean()])
        best = None
        if len(np.unique(y[rows])) > 1:
            for j in range(x.shape[1]):
                seen = np.unique(x[rows, j])
                for low, high in zip(seen, seen[1:]):
                    left = x[rows, j] <= low
                    gain = impurity_sum(rows[left]) + impurity_sum(rows[~left])
                    if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                        best = (gain, j, low + (high - low) / 2)
        if best is None:
            return lambda v: leaf
        _, j, cut = best
        left, right = build(rows[x[rows, j] <= cut]), build(rows[x[rows, j] > cut])
        return lambda v: left(v) if v[j] <= cut else right(v)

    return build(np.arange(len(y)))


@pytest.mark.parametrize("n_classes", [0, 3])
def test_a_tree_is_the_one_that_trying_everything_gives(n_classes):
    rng = np.random.default_rng(4 + n_classes)
    x = rng.integers(0, 9, (120, 3)).astype(float) + rng.random((120, 3)) * 1e-3
    y = rng.integers(0, n_classes, 120).astype(float) if n_classes else rng.normal(0, 3, 120).round(2)
    growth = forest.Growth(1, n_classes, 3, 3, False, None, 42, 1 << 17)
    nodes, gains = forest.grow(x, y, np.ones(120, dtype=np.int64), growth, 7, None)
    want = plain_tree(x, y, n_classes)
    asked = np.concatenate([x, rng.random((200, 3)) * 9])
    got = nodes.value[nodes.walk(asked)]
    assert np.abs(got - np.array([want(v) for v in asked])).max() < 1e-9
    assert (gains >= 0).all() and gains.sum() > 0


def cells(model):
    return [tuple(r) for r in model.finished.drop("gains").orderBy("tree", "leaf").collect()]


@pytest.mark.parametrize("bound", [None, 150])
@pytest.mark.parametrize("name", list(FORESTS))
def test_the_same_seed_gives_the_same_trees(spark, name, bound):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 30, (700, 4)).astype(float)
    y = (x[:, 0] * 3 + x[:, 1] * rng.random(700)).round(1) if "regressor" in name else (x[:, 0] + x[:, 1] > 25 + rng.integers(0, 9, 700)).astype(float)
    drawn, some = FORESTS[name]
    options = dict(n_inputs=4, n_classes=0 if "regressor" in name else 2, trees=7 if drawn else 1, tried=2 if some else 4, sampled=drawn, bound=bound)
    one = forest.fit_forest(table(spark, x, y, 3), **options)
    two = forest.fit_forest(table(spark, x[::-1], y[::-1], 8), **options)
    assert one.top.trees == two.top.trees and cells(one) == cells(two)
    assert (bound is None) == all(len(t) == 1 for t in one.top.trees)


@pytest.mark.parametrize("bound", [None, 60])
def test_trees_grow_until_nothing_can_be_split(spark, bound):
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(0, 4, (800, 3)))
    y = rng.normal(0, 1, 800)
    model = forest.fit_forest(table(spark, x, y), 3, bound=bound)
    off = model.transform(table(spark, x, y)).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert off < 1e-12 and model.depth > 8
    assert not reaches_depth(Fitted("decision_tree_regressor", model), None)
    assert abs(sum(model.featureImportances) - 1) < 1e-9


def test_a_node_whose_rows_are_alike_is_summed_not_gathered(spark):
    """Three kinds of rows with a thousand targets each: larger nodes than the bound, which nothing can split."""
    rng = np.random.default_rng(6)
    kind = rng.integers(0, 3, 3000)
    x, y = np.stack([kind == 0, kind == 1], axis=1).astype(float), rng.normal(0, 1, 3000) + kind * 10
    model = forest.fit_forest(table(spark, x, y), 2, bound=100)
    assert {len(r["feature"]) for r in model.finished.collect()} == {1}
    got = {tuple(r.features): r.prediction for r in model.transform(table(spark, x, y)).select("features", "prediction").distinct().collect()}
    for k in range(3):
        assert got[(float(k == 0), float(k == 1))] == pytest.approx(y[kind == k].mean())
    shares = forest.fit_forest(table(spark, x, (y > 10).astype(float)), 2, n_classes=2, bound=2)
    near = shares.transform(table(spark, x, y)).groupBy("features").agg(F.first("shares").alias("s")).collect()
    assert {round(r.s[1], 9) for r in near} == {round(float((y[kind == k] > 10).mean()), 9) for k in range(3)}


def test_depth_is_a_bound_in_both_parts(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((500, 3)), rng.random(500)
    for bound, depth in ((None, 3), (50, 2), (200, 4)):
        model = forest.fit_forest(table(spark, x, y), 3, depth=depth, bound=bound)
        assert model.depth <= depth and reaches_depth(Fitted("decision_tree_regressor", model), depth)


@pytest.mark.parametrize("n_classes", [0, 3])
def test_a_large_model_is_asked_by_routing(spark, monkeypatch, tmp_path, n_classes):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 50, (400, 3)).astype(float)
    y = rng.integers(0, 3, 400).astype(float) if n_classes else x[:, 0] + rng.random(400)
    model = forest.fit_forest(table(spark, x, y), 3, n_classes=n_classes, trees=5, tried=1, sampled=True, bound=90)
    asked = table(spark, x, y)
    columns = ["features", "label", "prediction", *(["shares"] if n_classes else [])]

    def answers(m):
        out = [[v for c in r for v in (c if isinstance(c, list) else [c] if isinstance(c, float) else list(c))]
               for r in m.transform(asked).select(*columns).collect()]
        return np.array(sorted(out))

    here = answers(model)
    monkeypatch.setattr(forest, "MODEL_BYTES", 0)
    assert np.abs(answers(model) - here).max() < 1e-9
    model.save(str(tmp_path / "m"))
    loaded = forest.ForestModel.load(spark, str(tmp_path / "m"))
    assert np.abs(answers(loaded) - here).max() < 1e-9 and loaded.growth == model.growth


@pytest.mark.parametrize("n_classes", [0, 3])
@pytest.mark.parametrize("few", [(256, 1024), (256, 5), (256, 0), (3, 1024)])
def test_values_added_up_first_give_the_same_tree(monkeypatch, n_classes, few):
    """Columns of few values and of many, with weights, all of few values together or each alone."""
    rng = np.random.default_rng(11)
    n = 400
    x = np.column_stack([rng.random(n), rng.integers(0, 2, n), rng.integers(0, 7, n), rng.integers(0, 300, n)]).astype(float)
    y = rng.integers(0, 3, n).astype(float) if n_classes else (x[:, 0] * 50 % 7 + x[:, 2] * rng.random(n)).round(2)
    w = rng.integers(1, 4, n)
    monkeypatch.setattr(forest, "FEW", few[0])
    monkeypatch.setattr(forest, "TOGETHER_FEW", few[1])
    growth = forest.Growth(1, n_classes, 4, 4, False, None, 42, 1 << 17)
    nodes, _ = forest.grow(x, y, w, growth, 7, None)
    want = plain_tree(np.repeat(x, w, axis=0), np.repeat(y, w), n_classes)
    got = nodes.value[nodes.walk(x)]
    assert np.abs(got - np.array([want(v) for v in x])).max() < 1e-9


def test_rows_of_one_file_are_dealt_among_tasks(spark, monkeypatch):
    """Trees grow and are asked in as many tasks as the work needs, and a node is copied only if many rows ask for it."""
    rng = np.random.default_rng(12)
    x, y = rng.random((9000, 2)).round(3), rng.random(9000).round(2)
    options = dict(n_inputs=2, trees=3, sampled=True, bound=2000)
    one = forest.fit_forest(table(spark, x, y, 1), **options)
    want = one.transform(table(spark, x, y, 1)).select("features", "prediction").collect()
    written = {}

    def counted(df, label, durable=forest.durable):
        out = durable(df, label)
        written[label] = out.select(F.spark_partition_id().alias("p")).distinct().count(), df.rdd.getNumPartitions()
        return out

    monkeypatch.setattr(forest, "durable", counted)
    monkeypatch.setattr(forest, "SHARE_ROWS", 1500)
    monkeypatch.setattr(forest, "MODEL_BYTES", 0)
    monkeypatch.setattr(forest, "ASKED", 1000)
    two = forest.fit_forest(table(spark, x, y, 1), **options)
    assert written["forest-shares"][1] == 6
    assert one.top.trees == two.top.trees and cells(one) == cells(two)
    got = two.transform(table(spark, x, y, 1)).select("features", "prediction").collect()
    assert np.abs(np.array(sorted((*r.features, r.prediction) for r in got)) - np.array(sorted((*r.features, r.prediction) for r in want))).max() < 1e-9


def test_copies_are_drawn_one_by_one():
    checks = np.arange(20_000, dtype=np.int64) * 7919
    for copies in (1, 3, 200):
        got = forest._drawn(checks[:4000 if copies > 64 else None], np.full(4000 if copies > 64 else 20_000, copies), 3, 42)
        assert got.mean() == pytest.approx(copies, rel=0.03) and got.var() == pytest.approx(copies, rel=0.08)


def test_least_squares_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 300
    kind, other = rng.integers(0, 4, n), rng.integers(0, 3, n)
    base = np.concatenate([np.eye(4)[kind], np.eye(3)[other], rng.normal(1e4, 1e-2, (n, 1)), np.full((n, 1), 3.0)], axis=1)
    x = np.concatenate([base, (base[:, :1] + 2 * base[:, 4:5]), rng.normal(0, 1e5, (n, 1))], axis=1)
    y = kind * 2.0 - other + 40 * (x[:, 7] - 1e4) + x[:, 10] * 1e-5 + rng.normal(0, 0.1, n)
    fitted = fit_model("linear_regression", table(spark, x, y, 7), n, x.shape[1])
    centred = x - x.mean(axis=0)
    want = np.linalg.lstsq(np.column_stack([np.ones(n), centred]), y, rcond=1e-13)[0]
    got = fitted.transform(table(spark, x, y)).select("features", "prediction").collect()
    for r in got:
        assert r.prediction == pytest.approx(float(want[0] + (r.features.toArray() - x.mean(axis=0)) @ want[1:]), abs=1e-5)
    assert fitted.model.rank == 4 - 1 + 3 - 1 + 1 + 1
    assert fitted.model.coefficients[8] == pytest.approx(0, abs=1e-9)
    # Indicators of one column that sum to one share the least norm: their coefficients sum to zero as far as others let them.
    simple = fit_model("linear_regression", table(spark, np.eye(4)[kind], y), n, 4).model
    assert sum(simple.coefficients) == pytest.approx(0, abs=1e-9) and simple.rank == 3
    fitted.save(str(tmp_path / "linear"))
    again = Fitted.load(spark, "linear_regression", str(tmp_path / "linear"))
    assert list(again.model.coefficients) == list(fitted.model.coefficients) and again.model.intercept == fitted.model.intercept


def test_factors_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(linear, "MERGED", 2)
    x = np.random.default_rng(5).random((40, 2))
    fitted = linear.fit_linear(table(spark, x, x @ [2.0, -3.0] + 5, 9), 2)
    assert list(fitted.coefficients) == pytest.approx([2.0, -3.0]) and fitted.intercept == pytest.approx(5.0)
    few = linear.fit_linear(table(spark, x[:1], [4.0], 1), 2)
    assert (few.rank, few.intercept, list(few.coefficients)) == (0, 4.0, [0.0, 0.0])


def test_uneven_splits_do_not_read_a_large_node_again_and_again(monkeypatch):
    """A target that rises and falls back: every split takes a few rows from one end."""
    n, read = 60_000, [0]
    x = np.column_stack([np.arange(n) * 0.5, np.arange(n) * 7 % 5]).astype(float)
    y = np.arange(n) % 500 / 10.0

    def counted(values, runs=forest._runs):
        read[0] += len(values)
        return runs(values)

    monkeypatch.setattr(forest, "_runs", counted)
    nodes, _ = forest.grow(x, y, np.ones(n, dtype=np.int64), forest.Growth(1, 0, 2, 2, False, None, 42, n), 7, None)
    assert nodes.depth > 100 and np.abs(nodes.value[nodes.walk(x), 0] - y).max() < 1e-9
    assert read[0] < 100 * n


@pytest.mark.parametrize("depth", [None, 5])
@pytest.mark.parametrize("sizes", [(3, 4), (20, 16), (40, 512)])
def test_large_nodes_are_split_as_small_ones(monkeypatch, sizes, depth):
    """Ties, steps, few values and weights; the larger side loses rows from all its features."""
    rng = np.random.default_rng(13)
    n = 700
    x = np.column_stack([rng.random(n).round(2), rng.random(n), rng.integers(0, 5, n), rng.integers(0, 2, n), np.exp(rng.normal(0, 3, n))])
    y = np.where(rng.random(n) < 0.2, 3.0, (x[:, 0] * 40 % 3 + x[:, 2] * rng.random(n)).round(2))
    y[rng.permutation(n)[:5]] = 1e3
    w = rng.integers(1, 4, n)
    growth = forest.Growth(1, 0, 5, 5, False, depth, 42, 1 << 17)
    monkeypatch.setattr(forest, "FEW", 50)
    monkeypatch.setattr(forest, "MANY", n)
    plain, gains = forest.grow(x, y, w, growth, 7, depth)
    for name, value in zip(("MANY", "BLOCK"), sizes):
        monkeypatch.setattr(forest, name, value)
    nodes, found = forest.grow(x, y, w, growth, 7, depth)
    asked = np.concatenate([x, rng.random((300, 5))])
    assert np.abs(nodes.value[nodes.walk(asked)] - plain.value[plain.walk(asked)]).max() < 1e-9
    assert (nodes.depth, len(nodes.left)) == (plain.depth, len(plain.left)) and np.allclose(found, gains)
    few = forest.Growth(1, 0, 5, 2, False, depth, 42, 1 << 17)
    assert np.allclose(forest.grow(x, y, w, few, 7, depth)[0].threshold.sum(), forest.grow(x, y, w, few, 7, depth)[0].threshold.sum())


def test_rows_are_packed_and_unpacked():
    import pyarrow as pa

    rng = np.random.default_rng(14)
    x = np.column_stack([rng.random(5000), rng.integers(0, 50, 5000) / 7, rng.integers(0, 2, 5000)])
    rows = np.array([4999, 0, 17])
    parts = [forest.Packer(x[:3000]).pack(np.arange(3000)), forest.Packer(x[3000:]).pack(np.arange(2000)), forest.Packer(x[3000:3010]).pack(rows[1:2])]
    # Eight bytes and one for each of the two features of few values.
    assert len(parts[0]) < 3000 * 10 + 1000
    got = forest._unpack_rows(pa.array(parts, pa.binary()), 3)
    assert (got == np.concatenate([x, x[3000:3001]])).all()
