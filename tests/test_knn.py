import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import knn


def brute(train, queries, k):
    out = {}
    for qid, q in queries:
        near = sorted(((float(((np.array(q) - np.array(v)) ** 2).sum()), nid) for nid, _, v in train))[:k]
        out[qid] = [nid for _, nid in near]
    return out


def run(spark, train, queries, k, monkeypatch, block=None):
    if block:
        monkeypatch.setattr(knn, "TRAIN_BLOCK", block)
        monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    t = spark.createDataFrame(train, "nid long, label long, vec array<double>")
    q = spark.createDataFrame(queries, "qid long, vec array<double>")
    rows = knn.knn_join(t, q, k).orderBy("qid", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append(r["nid"])
    return got


@pytest.mark.parametrize("n, m, d, spread, block", [(300, 80, 2, 0.02, None), (400, 100, 5, 0.5, 16), (60, 20, 8, 2.0, 8)])
def test_matches_brute_force(spark, monkeypatch, n, m, d, spread, block):
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 1, (6, d))
    points = lambda k: (centres[rng.integers(0, 6, k)] + rng.normal(0, spread, (k, d))).round(3)
    train = [(i, i % 3, v.tolist()) for i, v in enumerate(points(n))]
    queries = [(1000 + i, v.tolist()) for i, v in enumerate(points(m))]
    assert run(spark, train, queries, 3, monkeypatch, block) == brute(train, queries, 3)


def test_hot_copies_and_ties(spark, monkeypatch):
    train = [(i, i % 2, [1.0, 1.0]) for i in range(100)] + [(200 + i, 1, [float(i), 0.0]) for i in range(50)]
    queries = [(i, [1.0, 1.0]) for i in range(60)] + [(100 + i, [float(i) + 0.5, 0.0]) for i in range(40)]
    assert run(spark, train, queries, 3, monkeypatch, 8) == brute(train, queries, 3)


def test_fewer_training_rows_than_neighbours(spark, monkeypatch):
    train = [(1, 0, [0.0]), (2, 1, [5.0])]
    assert run(spark, train, [(7, [1.0])], 3, monkeypatch) == {7: [1, 2]}


def test_vote_ties_go_to_the_smallest_class(spark):
    rows = [(1, 10, 2, 0.1, 1), (1, 11, 0, 0.2, 2), (1, 12, 1, 0.3, 3), (2, 10, 5, 0.0, 1), (2, 13, 5, 0.0, 2), (2, 14, 1, 0.0, 3)]
    near = spark.createDataFrame(rows, "qid long, nid long, label long, distance2 double, rank int")
    got = {r["qid"]: (r["prediction"], round(r["confidence"], 4)) for r in knn.knn_predict(near).collect()}
    assert got == {1: (0, 0.3333), 2: (5, 0.6667)}
    assert knn.knn_votes(near).agg(F.sum("share")).first()[0] == pytest.approx(2)


def test_tiles_agree_with_one_sort(monkeypatch):
    monkeypatch.setattr(knn, "QUERY_TILE", 3)
    monkeypatch.setattr(knn, "TRAIN_TILE", 4)
    rng = np.random.default_rng(5)
    q, t = rng.integers(0, 3, (10, 2)).astype(float), rng.integers(0, 3, (23, 2)).astype(float)
    rows, cols, far = knn._nearest(q, t, 3)
    want = np.argsort(knn._squared(q, t), axis=1, kind="stable")[:, :3]
    assert cols.reshape(10, 3).tolist() == want.tolist() and rows.tolist() == np.repeat(np.arange(10), 3).tolist()
    assert far.tolist() == knn._squared(q, t)[rows, cols].tolist()


def test_squared_distances():
    a, b = np.array([[0.0, 0.0], [1.0, 2.0]]), np.array([[3.0, 4.0]])
    assert knn._squared(a, b).tolist() == [[25.0], [8.0]]
    assert knn._stack(pd.Series([], dtype=object)).shape == (0, 0)


def test_buckets_find_most_neighbours(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (40, 24))
    points = lambda n: (centres[rng.integers(0, 40, n)] + rng.normal(0, 0.15, (n, 24))).round(4)
    train = [(i, i % 3, v.tolist()) for i, v in enumerate(points(2000))]
    queries = [(9000 + i, v.tolist()) for i, v in enumerate(points(100))]
    t = spark.createDataFrame(train, "nid long, label long, vec array<double>")
    q = spark.createDataFrame(queries, "qid long, vec array<double>")
    got = {}
    for r in knn.knn_join_lsh(t, q).collect():
        got.setdefault(r["qid"], {})[r["nid"]] = r["rank"]
    want = brute(train, queries, 3)
    found = sum(len(set(want[i]) & got.get(i, {}).keys()) for i in want)
    assert found / (3 * len(want)) > 0.9
    assert all(sorted(ranks.values()) == list(range(1, len(ranks) + 1)) for ranks in got.values())


def test_report_of_the_visited_share(spark):
    rng = np.random.default_rng(12)
    rows = [(i, 0, [float(i // 100) * 50 + x, x]) for i, x in enumerate(rng.random(400).tolist())]
    report = {}
    t = spark.createDataFrame(rows, "nid long, label long, vec array<double>")
    knn.knn_join(t, t.select(F.col("nid").alias("qid"), "vec").limit(50), 3, report=report).count()
    assert report["queries"] == 50 and 0 < report["visited_share"] < 0.7


def test_few_vectors_are_compared_in_many_dimensions(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("nid"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    queries = rows.where("nid % 5 = 0").select(F.col("nid").alias("qid"), "vec")
    train = rows.where("nid % 5 <> 0")
    report = {}
    got = {}
    for r in knn.knn_join(train, queries, 3, report=report).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["nid"])
    want = brute([tuple(r) for r in train.collect()], [tuple(r) for r in queries.collect()], 3)
    assert got == want
    assert 0 < report["compared_share"] < 0.2


@pytest.mark.parametrize("width, scale, shift", [(3, 1.0, 0.0), (40, 1e-6, 1e6), (20, 1e9, -1e9)])
def test_bounds_hold_for_far_rows_and_odd_scales(spark, monkeypatch, width, scale, shift):
    """A few rows lie far off the grid, and many are equal or nearly so."""
    rng = np.random.default_rng(width)
    points = np.concatenate([rng.normal(0, 1, (150, width)), rng.normal(0, 1, (5, width)) * 1e4, np.zeros((30, width)),
                             rng.integers(0, 2, (60, width)).astype(float)]) * scale + shift
    train = [(i, 0, v.tolist()) for i, v in enumerate(points[::2])]
    queries = [(i, v.tolist()) for i, v in enumerate(points[1::2])]
    got = run(spark, train, queries, 3, monkeypatch, 16)
    for qid, q in queries:
        exact = sorted((float(sum((a - b) * (a - b) for a, b in zip(q, v))), nid) for nid, _, v in train)
        assert got[qid] == [nid for _, nid in exact[:3]]


def test_codes_bound_distances():
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (50, 30)) * np.linspace(0.001, 5, 30)
    vectors[7] *= 100
    low = vectors.min(axis=0).clip(-10)
    grid = knn.Grid(low, 20 / 255, 1e-12)
    codes, off = grid.codes(vectors)
    plain = grid.decoded(pd.Series(codes))
    rows, cols, least, most = knn._candidates(plain, off, np.full(50, np.inf), plain, off, grid.step, 50)
    far = np.sqrt(knn._squared(vectors, vectors))
    assert len(rows) == 2500 and (least <= far[rows, cols]).all() and (far[rows, cols] <= most).all()
