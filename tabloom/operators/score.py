"""Scoring new rows: input check, decoding, class shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import c
from tabloom.functions.numbers import parse_number, parse_typed_number, strip_number_format
from tabloom.session import broadcast_if_small

# Reasons for turning a row away.
MISSING, NOT_NUMERIC, UNKNOWN_LEVEL = "missing", "not numeric", "unknown level"


def is_blank(col: Column) -> Column:
    return col.isNull() | col.cast("string").rlike(r"^\s*$")


def validate_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Cast the features to numbers; ``reason`` names the first bad one, else NULL."""
    absent = [n for n in features if n not in df.columns]
    if absent:
        raise ValueError(f"the input lacks feature column(s) {absent}")
    reasons = []
    for n in features:
        reasons.append(F.when(c(f"__{n}").isNull(), F.when(is_blank(c(n)), F.lit(f"{n}: {MISSING}")).otherwise(
            F.lit(f"{n}: {NOT_NUMERIC}"))))
    others = [c(n) for n in df.columns if n not in features]
    parsed = df.withColumns({f"__{n}": parse_typed_number(c(n)) for n in features})
    return parsed.select(*others, *[c(f"__{n}").alias(n) for n in features],
                         F.coalesce(*reasons, F.lit(None).cast("string")).alias("reason"))


def typed_inputs(df: DataFrame, types: dict[str, str], texts_as_numbers: dict[str, str], carried: list[str],
                 reason: str = "reason", unused: set[str] = frozenset()) -> DataFrame:
    """Input columns in their stored types; ``reason`` names the first that cannot be read as a number, else NULL.

    Columns that no feature is made of (``unused``) give no reason.

    A missing cell is no such case: a stored fill may replace it. Columns
    that were text when the state was learned but held numbers are checked by
    the same rules as then, and stay text here.
    """
    numeric = {n for n, t in types.items() if t in ("bigint", "double")}
    columns, reasons = [], []
    for n, t in types.items():
        cell = c(n)
        if n in numeric:
            value = parse_typed_number(cell)
            out = value.try_cast(t) if t == "bigint" else value
        else:
            out = cell.try_cast(t)
            value = parse_number(strip_number_format(cell.cast("string"))) if n in texts_as_numbers else cell
        columns.append(out.alias(n))
        if n not in unused:
            reasons.append(F.when(value.isNull() & ~is_blank(cell), F.lit(f"{n}: {NOT_NUMERIC}")))
    return df.select(*[c(n) for n in carried], *columns, F.coalesce(*reasons, F.lit(None).cast("string")).alias(reason))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NULL").drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NOT NULL")


def class_percentages(shares: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Class probabilities in percent, 1 decimal, greatest first per row."""
    named = shares.join(broadcast_if_small(classes), "class_index")
    return named.select(c(key), "class_label", F.bround(F.col("share") * 100, 1).alias("percentage")).orderBy(
        c(key), F.desc("percentage"), "class_label")
