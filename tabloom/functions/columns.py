"""Column naming and type helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC_TYPES = INTEGER_TYPES + (T.FloatType, T.DoubleType, T.DecimalType)
TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)


def c(name: str) -> Column:
    """Column by exact name; headers may hold dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGER_TYPES)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEXT_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def unique_names(names: Iterable[str], case_sensitive: bool = True) -> list[str]:
    """Give repeated names the suffixes ``.1``, ``.2`` …"""
    fold = (lambda s: s) if case_sensitive else str.lower
    seen: set[str] = set()
    out = []
    for name in names:
        candidate, k = name, 0
        while fold(candidate) in seen:
            k += 1
            candidate = f"{name}.{k}"
        seen.add(fold(candidate))
        out.append(candidate)
    return out


def case_sensitive(df: DataFrame) -> bool:
    return df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"


def normalise(df: DataFrame) -> DataFrame:
    """Bring any table to the types a CSV could hold.

    NaN becomes NULL, so that one test finds all missing values; integers are
    widened, decimals and floats become doubles, dates and timestamps text.
    """

    def one(field: T.StructField) -> Column:
        col, t = c(field.name), field.dataType
        if isinstance(t, (T.FloatType, T.DoubleType)):
            out = F.nullif(col.cast("double"), F.lit(float("nan")))
        elif isinstance(t, T.DecimalType):
            out = col.cast("double")
        elif is_integer(t):
            out = col.cast("long")
        elif isinstance(t, T.BooleanType) or is_text(t):
            out = col
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out = col.cast("string")
        else:
            raise ValueError(f"column {field.name!r} has type {t.simpleString()}, which a table of cells cannot hold")
        return out.alias(field.name)

    return df.select([one(f) for f in df.schema])
