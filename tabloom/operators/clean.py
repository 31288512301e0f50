"""Dropping columns, duplicates and number formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import c, text_columns
from tabloom.functions.numbers import parse_integer, parse_number, strip_number_format

ROW_KEY = "__row_key"
COPIES = "__copies"

# Fixed value: share of readable cells above which a text column is a number.
NUMERIC_TEXT_RATE = 0.8


def drop_excluded(df: DataFrame, excluded: list[str], target: str | None = None) -> DataFrame:
    """Drop the named columns; unknown names and the target are ignored."""
    gone = {n for n in excluded if n != target}
    return df.select([c(n) for n in df.columns if n not in gone])


def distinct_rows(df: DataFrame, key: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """One row per distinct content, with its number of copies and a row key.

    Key columns are compared like any other unless they are ``ignored``; of
    rows that differ in ignored columns only, the smallest ignored values
    stay. Copies are summed inside each task first, so a row that fills a
    third of the table reaches the exchange once per task. The row key is the
    key columns as text, or without such columns a digest of the row, which is
    unique after this step.
    """
    key = list(key or [])
    unseen = [n for n in key if n in (ignored or [])]
    content = [n for n in df.columns if n not in key]
    compared = [n for n in df.columns if n not in unseen]
    copies = F.count(F.lit(1)).alias(COPIES)
    if not key:
        return df.groupBy(*[c(n) for n in content]).agg(copies).select("*", row_digest(content).alias(ROW_KEY))
    if not unseen:
        grouped, first = df.groupBy(*[c(n) for n in compared]).agg(copies), {}
    elif len(unseen) == 1:
        # A number as key keeps the aggregate hash-based.
        grouped = df.groupBy(*[c(n) for n in compared]).agg(copies, F.min(c(unseen[0])).alias("__first"))
        first = {unseen[0]: F.col("__first")}
    else:
        smallest = F.min(F.struct(*[c(n) for n in unseen]))
        grouped = df.groupBy(*[c(n) for n in compared]).agg(copies, smallest.alias("__first"))
        first = {n: F.col("__first")[n] for n in unseen}
    parts = [first.get(n, c(n)).cast("string") for n in key]
    named = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    return grouped.select(*[c(n) for n in content], COPIES, named.alias(ROW_KEY))


def row_digest(columns: list[str]):
    """Digest that tells NULL from empty text and cell borders apart."""
    return F.md5(F.to_json(F.struct(*[c(n) for n in columns]), {"ignoreNullFields": "false"}))


def duplicate_report(df: DataFrame) -> DataFrame:
    rows = distinct_rows(df)
    return rows.agg(
        F.sum(COPIES).alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
        (F.sum(COPIES) - F.count(F.lit(1))).alias("n_removed"),
    )


def number_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: filled cells, those readable as numbers, and the rate."""
    names = columns if columns is not None else text_columns(df)
    aggs = []
    for i, n in enumerate(names):
        cell = strip_number_format(c(n))
        aggs += [
            F.count(c(n)).alias(f"filled_{i}"),
            F.count(parse_number(cell)).alias(f"number_{i}"),
            F.count(parse_integer(cell)).alias(f"integer_{i}"),
        ]
    lines = []
    for i, n in enumerate(names):
        rate = F.try_divide(F.col(f"number_{i}").cast("double"), F.col(f"filled_{i}").cast("double"))
        lines.append(F.struct(
            F.lit(n).alias("column"),
            F.col(f"filled_{i}").alias("n_filled"),
            F.col(f"number_{i}").alias("n_numbers"),
            F.col(f"integer_{i}").alias("n_integers"),
            rate.alias("rate"),
            (F.coalesce(rate, F.lit(0.0)) > NUMERIC_TEXT_RATE).alias("is_number"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*lines)))


def numeric_text_types(rates: list, rows: int) -> dict[str, str]:
    """Which text columns become numbers, and of which type.

    Whole numbers without a gap become ``long``; anything else ``double``.
    """
    return {
        r["column"]: "long" if r["n_integers"] == rows else "double"
        for r in rates if r["is_number"]
    }


def apply_number_format(df: DataFrame, types: dict[str, str]) -> DataFrame:
    parse = {"long": parse_integer, "double": parse_number}
    return df.select([
        parse[types[n]](strip_number_format(c(n))).alias(n) if n in types else c(n) for n in df.columns
    ])


def clean_number_formats(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = text_columns(df)
    if not names:
        return df, {}
    rows = df.agg(F.count(F.lit(1))).first()[0]
    types = numeric_text_types(number_rates(df, names).collect(), rows)
    return apply_number_format(df, types), types
