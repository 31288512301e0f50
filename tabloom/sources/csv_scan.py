"""CSV scan with typed columns."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tabloom.functions.columns import c, unique_names
from tabloom.functions.numbers import parse_integer, parse_number
from tabloom.session import broadcast_if_small, durable

# Cell texts read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Cell texts read as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

_EXTRA = "__extra_field"


@dataclass(frozen=True)
class FileFacts:
    path: str
    first_line: str
    multi_line: bool


def file_facts(spark: SparkSession, path: str | list[str]) -> list[FileFacts]:
    """Header line of every file that is not empty, and whether any of its records spans lines.

    A record spans lines exactly when some line holds an odd number of quotes.
    One pass counts quotes and finds each file's first line by position, a
    second one fetches those lines.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        (F.col("_metadata.file_block_start") == 0).alias("leads"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    facts = lines.groupBy("file").agg(
        F.min(F.when(F.col("leads"), F.col("at"))).alias("at"),
        F.max(F.col("value").contains('"') & (quotes % 2 == 1)).alias("odd")).collect()
    places = spark.createDataFrame([(r["at"],) for r in facts], "at long")
    # One number per file.
    first = {r["file"]: r["value"] for r in lines.join(F.broadcast(places), "at", "left_semi").collect()}
    return [FileFacts(r["file"], first[r["file"]], r["odd"]) for r in sorted(facts, key=lambda r: r["file"])]


_OPTIONS = {"escape": '"', "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE"}


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def _mark_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each split and say where, for either parity at its start, the record of a line begins."""
    here, number, quotes, starts = None, 0, 0, [-1, -1]
    for batch in batches:
        file, block = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        odd = pc.fill_null(pc.count_substring(batch.column(0), '"'), 0).to_numpy(zero_copy_only=False) % 2
        numbers, begins = np.zeros(len(odd), dtype=np.int64), np.zeros((2, len(odd)), dtype=np.int64)
        for i in range(len(odd)):
            if (file[i], block[i]) != here:
                here, number, quotes, starts = (file[i], block[i]), 0, 0, [-1, -1]
            starts[quotes] = number
            numbers[i], begins[:, i] = number, starts
            number += 1
            quotes ^= int(odd[i])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(odd.astype(np.int64)), pa.array(numbers), pa.array(begins[0]), pa.array(begins[1])],
            names=["value", "file", "block", "odd", "number", "begin_0", "begin_1"])


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """The records of CSV files whose cells may hold line breaks, without the header; many tasks share a file.

    A line begins a record if the quotes before it are even in number. Each
    split counts its own for both cases, a prefix over the splits of a file
    tells which case holds, and only the lines of records that go over
    several lines are brought together.
    """
    lines = spark.read.option("lineSep", "\n").text(files).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    marked = lines.mapInArrow(_mark_lines, "value string, file string, block long, odd long, number long, begin_0 long, begin_1 long")
    splits = marked.groupBy("file", "block").agg(
        F.sum("odd").alias("odds"), F.max("begin_0").alias("last_0"), F.max("begin_1").alias("last_1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = splits.withColumn("parity", F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2)
    last = F.when(F.col("parity") == 0, F.col("last_0")).otherwise(F.col("last_1"))
    open_ = F.last(F.when(last >= 0, F.struct("block", last.alias("number"))), ignorenulls=True).over(before)
    known = durable(known.select("file", "block", "parity", open_.alias("open")), "splits")
    placed = marked.join(broadcast_if_small(known), ["file", "block"])
    begin = F.when(F.col("parity") == 0, F.col("begin_0")).otherwise(F.col("begin_1"))
    own = F.when(begin >= 0, F.struct("block", begin.alias("number"))).otherwise(F.col("open"))
    placed = placed.withColumn("record", own).withColumn(
        "alone", (begin == F.col("number")) & (F.col("odd") == 0))
    header = (F.col("record.block") == 0) & (F.col("record.number") == 0)
    body = placed.where(~header)
    long_ = body.where(~F.col("alone")).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "number", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    every = body.where("alone").select("value").unionByName(long_.select(joined.alias("value")))
    return every.select(F.regexp_replace("value", "\r$", "").alias("value")).where("trim(value) <> ''")


def _header(spark: SparkSession, file: FileFacts) -> tuple[str, ...]:
    if file.first_line.count('"') % 2:
        names = list(spark.read.options(**_OPTIONS).option("multiLine", True).option("header", False).csv(file.path).first())
    else:
        names = next(csv.reader([file.first_line.rstrip("\r")]), [])
    return tuple(unique_names(name if name not in (None, "") else f"Unnamed: {i}" for i, name in enumerate(names)))


def scan_text(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """All cells as text, missing tokens as NULL.

    Files may have their columns in any order, but all must have the same
    ones. One more column than the header names catches rows with too many
    fields. ``multi_line=None`` looks whether any cell holds a line break;
    such files are cut into records first, by as many tasks as they have splits.
    """
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file in file_facts(spark, path):
        several = file.multi_line if multi_line is None else multi_line
        groups.setdefault((_header(spark, file), several), []).append(file.path)
    if not groups:
        raise ValueError("the file holds no header line")
    names, known = None, None
    for (header, _), files in groups.items():
        if known is None:
            names, known = list(header), files[0]
        elif sorted(header) != sorted(names):
            raise ValueError(f"{files[0]} has the columns {list(header)}, but {known} has {names}")
    out = None
    for (header, several), files in groups.items():
        part = _scan_group(spark, files, list(header), several).select(*[c(n) for n in names], _EXTRA)
        out = part if out is None else out.unionByName(part)
    return out


def _scan_group(spark: SparkSession, files: list[str], names: list[str], multi_line: bool) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names + [_EXTRA]])
    if multi_line:
        cells = F.from_csv("value", _ddl(schema), _OPTIONS)
        raw = records(spark, files).select(cells.alias("cells")).select("cells.*")
    else:
        raw = spark.read.options(**_OPTIONS).schema(schema).option("header", True).option("enforceSchema", True).csv(files)
    return raw.select(
        *[F.when(~c(n).isin(NA_TOKENS), c(n)).alias(n) for n in names], F.col(_EXTRA)
    )


def _boolean(col: Column) -> Column:
    return F.when(col.isin(TRUE_TOKENS), F.lit(True)).when(col.isin(FALSE_TOKENS), F.lit(False))


def infer_types(text: DataFrame) -> dict[str, str]:
    """Type per column from one aggregate over all rows.

    A whole-number column with a missing cell is a double; a boolean column
    with a missing cell stays text; an all-missing column is a double.
    """
    names = [n for n in text.columns if n != _EXTRA]
    facts = [F.count(F.lit(1)).alias("rows")]
    if _EXTRA in text.columns:
        facts.append(F.count(_EXTRA).alias("overlong"))
    for i, n in enumerate(names):
        facts += [
            F.count(c(n)).alias(f"{i}_filled"),
            F.count(parse_integer(c(n))).alias(f"{i}_long"),
            F.count(parse_number(c(n))).alias(f"{i}_double"),
            F.count(_boolean(c(n))).alias(f"{i}_boolean"),
        ]
    row = text.agg(*facts).first()
    if _EXTRA in text.columns and row["overlong"]:
        _refuse(row["overlong"])
    types = {}
    for i, n in enumerate(names):
        filled, complete = row[f"{i}_filled"], row[f"{i}_filled"] == row["rows"]
        if filled == 0:
            types[n] = "double"
        elif row[f"{i}_boolean"] == filled:
            types[n] = "boolean" if complete else "boolean_text"
        elif row[f"{i}_long"] == filled and complete:
            types[n] = "long"
        elif row[f"{i}_double"] == filled:
            types[n] = "double"
        else:
            types[n] = "string"
    return types


def _refuse(overlong: int) -> None:
    raise ValueError(f"the CSV cannot be read: {overlong} row(s) have more fields than the header")


def overlong_rows(text: DataFrame) -> int:
    return text.agg(F.count(_EXTRA)).first()[0]


def apply_types(text: DataFrame, types: dict[str, str]) -> DataFrame:
    convert = {
        "long": parse_integer,
        "double": parse_number,
        "boolean": _boolean,
        "boolean_text": lambda col: F.initcap(col),
        "string": lambda col: col,
    }
    return text.select([convert[t](c(n)).alias(n) for n, t in types.items()])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Scan CSV files with a header line into typed columns.

    With ``schema`` given no inference pass runs, only a count of the rows
    that have more fields than the header, which are refused.
    """
    text = scan_text(spark, path, multi_line)
    if schema is not None:
        kinds = {"bigint": "long", "double": "double", "boolean": "boolean", "string": "string"}
        types = {f.name: kinds[f.dataType.simpleString()] for f in schema}
        missing = [n for n in types if n not in text.columns]
        if missing:
            raise ValueError(f"the CSV has no column(s) {missing}")
        overlong = overlong_rows(text)
        if overlong:
            _refuse(overlong)
        return apply_types(text, types)
    return apply_types(text, infer_types(text))
