import json

import pytest
from pyspark.sql import functions as F

from tabloom.plans import Workbench


def shop_csv(folder):
    lines = ["id,price,region,stock,grade"]
    for i in range(120):
        gap = "" if i % 11 == 0 else "NSEW"[i % 4]
        lines.append(f'{i},"${1000 + 37 * i % 900:,}",{gap},{i % 6},{"high" if i % 6 > 2 else "low"}')
    path = folder / "shop.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_from_file_to_report(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path / "root"))
    user = bench.store.create_user("a@b.c", "hash", "A")
    dataset = bench.upload(user, shop_csv(tmp_path))
    assert bench.preview(dataset, user).count() == 10
    report = {r["column"]: r for r in bench.column_report(dataset, user).collect()}
    assert report["region"]["n_missing"] == 11 and report["region"]["n_distinct"] == 4
    assert report["stock"]["mean"] == 2.5 and report["stock"]["n_distinct"] == 6
    assert report["price"]["dtype"] == "string" and len(report["region"]["top_values"]) == 3
    assert [r["column"] for r in bench.column_report(dataset, user, "GRA").collect()] == ["grade"]
    with pytest.raises(ValueError):
        bench.preprocess(dataset, user)
    assert bench.configure(dataset, user, "grade", excluded=["id"]) == "classification"
    drawn = bench.charts(dataset, user)
    assert drawn["target"].count() == 2 and "importance" not in drawn
    assert drawn["missing"].first()["column"] == "region" and drawn["correlations"].count() == 1
    trained = bench.preprocess(dataset, user, ["logistic_regression", "decision_tree"], test_size=0.25)
    best = trained.metrics.where(F.col("model") == trained.best_name).first()
    assert best["accuracy"] > 0.9
    rows = spark.createDataFrame([(1, "$1,200", "N", 5), (2, "$950", None, 0), (3, "cheap", "N", 1)],
                                 "id long, price string, region string, stock long")
    scored = {r["row_key"]: r for r in bench.predict(dataset, user, rows, "A", key=["id"]).collect()}
    assert scored["1"]["label"] == "high" and scored["2"]["label"] == "low"
    assert scored["3"]["reason"] == "price: not numeric" and scored["3"]["label"] is None
    assert [r["selected_model"] for r in bench.history(user).collect()] == [trained.best_name] * 2
    row = bench.dashboard(user).first()
    assert row["is_configured"] and row["is_preprocessed"] and row["target_column"] == "grade"
    record = bench.report(user).first()
    assert record["best_model_name"] == trained.best_name and len(record["history"]) == 2
    assert record["metrics"][trained.best_name] == pytest.approx(best["accuracy"])
    assert bench.admin()["total_predictions"] == 2
    summary = json.loads(bench.store.result_of(dataset).first()["summary_json"])
    assert summary["test_samples"] == 30 and summary["problem_type"] == "classification"
    bench.delete(dataset, user)
    assert bench.dashboard(user).count() == 0 and bench.report(user).count() == 0
    with pytest.raises(ValueError):
        bench.preview(dataset, user)


def test_refused_files(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path / "root"))
    (tmp_path / "t.txt").write_text("a,b\n1,2\n3,4\n5,6\n")
    (tmp_path / "small.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="extension"):
        bench.upload(1, str(tmp_path / "t.txt"))
    with pytest.raises(ValueError, match="at least 3 rows"):
        bench.upload(1, str(tmp_path / "small.csv"))
    with pytest.raises(ValueError, match="size"):
        bench.upload(1, str(tmp_path / "small.csv"), limit_mb=0.000001)
    assert bench.store.datasets().count() == 0
