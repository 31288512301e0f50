import duckdb
import pytest

import __spark_entry__ as driver
from tools.check import TABLES, compare

# The levels_* queries train every one of these model families on fewer trees, against SQL.
SLOW = {"rf_reg", "gbt_reg", "train_suite_regression", "train_suite_classification", "svm_rff", "rf_cls"}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - SLOW))
def test_query_matches_its_sql(spark, con, sf, name):
    text, _, ok = compare(spark, con, sf, name, driver.queries()[name], driver.oracle_sql().get(name))
    assert ok, text


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and "split" in df.columns


PLANNED = ["profile_top3", "upsert_latest", "insert_if_absent", "recent5_per_user", "latest_with_result", "report_record"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_ranks_are_limited_before_the_exchange(spark, sf, name):
    assert "WindowGroupLimit" in plan(driver.queries()[name](spark, sf))


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(driver.queries()["target_counts"](spark, sf))
    assert "ReadSchema: struct<l_returnflag:string>" in text and "PushedFilters: [IsNotNull(l_returnflag)]" in text
