import pytest
from pyspark.sql import functions as F

from tabloom.sources.admission import admission_report, list_files
from tabloom.sources.csv_scan import file_facts, read_csv, records
from tabloom.sources.validation import input_features, require_config, require_valid, validation_rules


def write(folder, text, name="a.csv"):
    path = folder / name
    path.write_text(text)
    return str(path)


def types(df):
    return dict(df.dtypes)


def test_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path, (
        "n,gap,f,b,bgap,s,empty,inf\n"
        "1,1,1.5,True,True,x,,inf\n"
        " 2,NA,2,FALSE,,null,NA,1\n"
        "3,3,1e3,true,false,NaN2,None,-2.5\n"))
    df = read_csv(spark, path)
    assert types(df) == {"n": "bigint", "gap": "double", "f": "double", "b": "boolean", "bgap": "string", "s": "string",
                         "empty": "double", "inf": "double"}
    rows = df.orderBy("n").collect()
    assert [r["gap"] for r in rows] == [1.0, None, 3.0]
    assert [r["bgap"] for r in rows] == ["True", None, "False"]
    assert [r["s"] for r in rows] == ["x", None, "NaN2"]
    assert rows[0]["inf"] == float("inf")


def test_suffixes_are_not_numbers(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, "a,b,c\n1d,1_000,0x10\n2d,15,0x11\n"))
    assert types(df) == {"a": "string", "b": "string", "c": "string"}


def test_quoted_line_breaks_and_headers(spark, tmp_path):
    path = write(tmp_path, 'a,a,,"x.y z"\n1,"say ""hi""","two\nlines",4\n2,plain,one,5\n')
    assert [f.multi_line for f in file_facts(spark, path)] == [True]
    df = read_csv(spark, path)
    assert df.columns == ["a", "a.1", "Unnamed: 2", "x.y z"]
    row = df.orderBy("a").first()
    assert row[1] == 'say "hi"' and row[2] == "two\nlines" and row[3] == 4


def test_plain_files_stay_splittable(spark, tmp_path):
    assert [f.multi_line for f in file_facts(spark, write(tmp_path, 'a,b\n"1",x\n2,"y, z"\n'))] == [False]


def test_records_over_many_splits(spark, tmp_path):
    rows = [(i, "line\n" * (i % 5) + 'say "hi", ' + "x" * (i % 37) + ("\n\n\"" if i % 11 == 0 else "")) for i in range(3000)]
    text = "id,cell\r\n" + "".join('{},"{}"\r\n'.format(i, c.replace('"', '""')) for i, c in rows)
    path = write(tmp_path, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
    try:
        assert records(spark, [path]).where("value LIKE '%say%'").rdd.getNumPartitions() > 1
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        got = sorted(tuple(r) for r in read_csv(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == rows


def test_files_may_order_their_columns_differently(spark, tmp_path):
    write(tmp_path, "a,b\n1,x\n2,y\n", "one.csv")
    write(tmp_path, "b,a\nq,7\n", "two.csv")
    df = read_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.select("a", "b").collect()) == [(1, "x"), (2, "y"), (7, "q")]
    write(tmp_path, "a,c\n1,x\n", "three.csv")
    with pytest.raises(ValueError, match="three.csv|one.csv|two.csv"):
        read_csv(spark, str(tmp_path))


def test_overlong_rows_are_refused_with_a_schema(spark, tmp_path):
    schema = spark.createDataFrame([], "a double, b string").schema
    with pytest.raises(ValueError, match="1 row"):
        read_csv(spark, write(tmp_path, "a,b\n1,x\n2,y,LOST\n"), schema)


def test_short_rows_are_filled_and_long_rows_refused(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, "a,b\n1,x\n2\n"))
    assert [r["b"] for r in df.orderBy("a").collect()] == ["x", None]
    with pytest.raises(ValueError, match="more fields"):
        read_csv(spark, write(tmp_path, "a,b\n1,x\n2,y,z\n", "b.csv"))


def test_schema_skips_inference(spark, tmp_path):
    schema = spark.createDataFrame([], "a double, b string").schema
    assert types(read_csv(spark, write(tmp_path, "a,b\n1,x\n2,7\n"), schema)) == {"a": "double", "b": "string"}


def test_too_small_table_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        require_valid(read_csv(spark, write(tmp_path, "col_a,col_b\n1,2\n")))


def test_valid_table_keeps_shape(spark, tmp_path):
    df = require_valid(read_csv(spark, write(tmp_path, "age,target\n20,0\n25,1\n30,1\n")))
    assert df.count() == 3 and df.columns == ["age", "target"]


@pytest.mark.parametrize("schema, rows, broken", [
    ("a long, b long", [], "not_empty"),
    ("a long", [(1,), (2,), (3,)], "enough_columns"),
    ("a long, b long", [(1, None), (2, None), (3, None)], "no_empty_column"),
])
def test_each_rule_can_break(spark, schema, rows, broken):
    verdict = {r["rule"]: r["ok"] for r in validation_rules(spark.createDataFrame(rows, schema)).collect()}
    assert not verdict[broken]
    with pytest.raises(ValueError):
        require_valid(spark.createDataFrame(rows, schema))


def test_config_rules():
    require_config(["a", "b"], "b", ["a"])
    for target, excluded in ((None, []), ("z", []), ("b", ["b"])):
        with pytest.raises(ValueError):
            require_config(["a", "b"], target, excluded)


def test_input_features():
    got = input_features([f"c{i}" for i in range(10)], "c9", ["c0"])
    assert got == {"count": 8, "first": [f"c{i}" for i in range(1, 7)], "more": 2}


def test_admission(spark, tmp_path):
    write(tmp_path, "x" * 2000, "big.CSV")
    write(tmp_path, "x", "small.csv")
    write(tmp_path, "x", "noextension")
    report = {r["file_name"]: (r["admitted"], r["reason"])
              for r in admission_report(list_files(spark, str(tmp_path)), limit_mb=0.001).collect()}
    assert report == {"big.CSV": (False, "size"), "small.csv": (True, None), "noextension": (False, "extension")}
    assert admission_report(list_files(spark, str(tmp_path))).where(F.col("admitted")).count() == 2
