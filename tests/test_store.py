import json

from pyspark.sql import functions as F

from tabloom.operators import rollup
from tabloom.sources.store import SCHEMAS, MetadataStore, insert_if_absent, prediction_rows


def log(store, spark, user, dataset, pairs):
    rows = spark.createDataFrame(pairs, "model string, prediction string, confidence double")
    store.log_predictions(prediction_rows(rows, F.lit(user), F.lit(dataset), F.lit("d"), F.lit("u"), F.col("model")))


def test_admin_statistics(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    user = store.create_user(" A@B.com ", "hash", "A B")
    dataset = store.save_dataset(user, "f.csv", "f.csv", "/f.csv", 10, 3, 1000)
    log(store, spark, user, dataset, [("knn", "a", 0.5), ("svm", "b", None), ("knn", "c", 0.75), ("knn", "a", 0.25),
                                      ("decision_tree", "b", 1.0)])
    got = rollup.admin_statistics(store.users(), store.datasets(), store.predictions())
    assert got == {"total_users": 1, "total_datasets": 1, "total_predictions": 5,
                   "most_used_algorithm": "knn", "best_average_accuracy": 1.0}


def test_empty_store(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    got = rollup.admin_statistics(store.users(), store.datasets(), store.predictions())
    assert got["most_used_algorithm"] == "N/A" and got["best_average_accuracy"] is None and got["total_users"] == 0


def test_users_are_unique_by_trimmed_lower_case(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    assert store.create_user("x@y.z", "h", "X") is not None
    assert store.create_user(" X@Y.Z", "h", "X") is None
    assert store.user_by_email("X@y.z ").count() == 1


def test_upserts_and_cascading_delete(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    user = store.create_user("x@y.z", "h", "X")
    kept = store.save_dataset(user, "a", "a", "/a", 1, 2, 3)
    gone = store.save_dataset(user, "b", "b", "/b", 1, 2, 3)
    for d in (kept, gone):
        store.save_config(d, user, "first")
        store.save_config(d, user, "second", "regression", ["p", 'q"r'])
        store.save_result(d, user, json.dumps({"target_column": "second"}))
        log(store, spark, user, d, [("m", "1", None)])
    row = store.config_of(kept).collect()
    assert [(r["target_column"], json.loads(r["excluded_columns"])) for r in row] == [("second", ["p", 'q"r'])]
    store.delete_dataset(gone, user + 1)
    assert store.datasets().count() == 2
    store.delete_dataset(gone, user)
    assert [r["id"] for r in store.datasets().collect()] == [kept]
    assert store.dataset_by_id(kept, user).count() == 1 and store.dataset_by_id(kept, user + 1).count() == 0
    assert store.configs().count() == store.results().count() == store.predictions().count() == 1
    store.delete_config(kept, user)
    assert store.config_of(kept).count() == 0
    store.save_config(kept, user, "third")
    assert store.config_of(kept).first()["target_column"] == "third"


def test_dashboard_flags(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    ids = [store.register(spark.range(5), 1, "a", f"n{i}", "/a", 2048) for i in range(3)]
    store.save_config(ids[0], 1, "t")
    store.save_config(ids[1], 1, "t")
    store.save_result(ids[1], 1, json.dumps({"target_column": "t", "best_model": {"name": "knn"}, "model_scores": {"knn": 0.5}}))
    rows = {r["id"]: r for r in rollup.dashboard(store.datasets(), store.configs(), store.results()).collect()}
    assert [(rows[i]["is_configured"], rows[i]["is_preprocessed"]) for i in ids] == [(True, False), (True, True), (False, False)]
    assert rows[ids[0]]["size_display"] == "2.0 KB" and rows[ids[0]]["num_rows"] == 5
    report = rollup.report_records(store.datasets(), store.results(), store.predictions()).collect()
    assert [(r["best_model_name"], r["metrics"], r["history"]) for r in report] == [("knn", {"knn": 0.5}, None)]


def test_insert_batch_keeps_the_first_of_each_key(spark):
    current = spark.createDataFrame([("a@a",)], "email string")
    batch = spark.createDataFrame([(1, " A@A"), (2, "b@b "), (3, "B@B"), (4, "c@c")], "n long, email string")
    got = sorted(tuple(r) for r in insert_if_absent(current, batch, "email", ["n"]).select("n", "email").collect())
    assert got == [(2, "b@b"), (4, "c@c")]


def filled(store, spark, users=6, rounds=3):
    for i in range(rounds):
        for user in range(users):
            log(store, spark, user, user, [(f"m{i}", str(i), i / 8)] * (1 + user))
    return sorted(map(str, store.predictions().collect()))


def test_compaction_changes_no_answer(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    user = store.create_user("x@y.z", "h", "X")
    kept, gone = (store.save_dataset(user, n, n, n, 1, 2, 3) for n in "ab")
    for d in (kept, gone):
        for target in ("first", "second"):
            store.save_config(d, user, target)
        store.save_result(d, user, "{}")
    store.delete_dataset(gone, user)

    def answers():
        tables = (store.users(), store.datasets(), store.configs(), store.results(), store.predictions())
        lookups = (store.user_by_email("X@y.z"), store.user_by_id(user), store.dataset_by_id(kept, user), store.config_of(kept),
                   store.result_of(kept), store.dataset_by_id(gone, user), store.config_of(gone))
        return [sorted(map(str, t.collect())) for t in (*tables, *lookups)]

    filled(store, spark, 2, 1)
    before = answers()
    for name in SCHEMAS:
        store.compact(name)
    assert answers() == before
    for name in SCHEMAS:
        store.clean(name)
    assert answers() == before and not list(tmp_path.glob("*/batches/*"))
    assert store._raw("model_configs").count() == 2
    store.save_config(kept, user, "third")
    store.delete_config(gone, user)
    assert store.config_of(kept).first()["target_column"] == "third"
    store.compact("model_configs")
    store.clean("model_configs")
    assert store.config_of(kept).first()["target_column"] == "third" and len(list(tmp_path.glob("model_configs/generations/*"))) == 1


def test_a_lost_compaction_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    store = MetadataStore(spark, str(tmp_path))
    before = filled(store, spark, 3, 1)
    store.compact("prediction_history")
    log(store, spark, 9, 9, [("late", "x", None)])
    now = sorted(map(str, store.predictions().collect()))
    assert len(now) == len(before) + 1

    def lost(*args):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as broken:
        broken.setattr(store, "_publish", lost)
        try:
            store.compact("prediction_history")
        except RuntimeError:
            pass
    assert sorted(map(str, store.predictions().collect())) == now
    # A generation that was not written to its end is passed over even if a manifest names it.
    number = store.compact("prediction_history")
    (tmp_path / f"prediction_history/generations/{number}/_SUCCESS").unlink()
    assert sorted(map(str, store.predictions().collect())) == now
    # An append that did not end is no batch.
    half = tmp_path / "prediction_history/batches/99999999999999999"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"PAR1")
    assert sorted(map(str, store.predictions().collect())) == now
    store.compact("prediction_history")
    assert sorted(map(str, store.predictions().collect())) == now


def test_lookups_read_one_partition(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    filled(store, spark, 6, 1)
    store.compact("prediction_history")
    store.clean("prediction_history")
    rows = store.predictions(3).where("user_id = 3")
    assert rows.count() == 4
    plan = store._raw("prediction_history", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition" in plan

    def files(rows):
        return rows.select(F.input_file_name()).distinct().count()

    assert files(store._raw("prediction_history", 3)) == 1 < files(store._raw("prediction_history"))
