"""Expressions on record fields: sizes, file names, JSON cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Admitted extension and the upload limit.
ADMITTED_EXTENSIONS = ["csv"]
DEFAULT_LIMIT_MB = 50


def human_size(size: Column) -> Column:
    """Bytes as ``B``, ``KB`` or ``MB`` with one decimal, ties to even."""
    kb, mb = 1024, 1024**2
    size = F.coalesce(size.cast("long"), F.lit(0))
    return (
        F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mb, F.format_string("%.1f KB", F.bround(size / F.lit(float(kb)), 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(size / F.lit(float(mb)), 1)))
    )


def file_extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def admitted_extension(name: Column, extensions: list[str] = ADMITTED_EXTENSIONS) -> Column:
    return F.coalesce(file_extension(name).isin(list(extensions)), F.lit(False))


def json_to_list(col: Column) -> Column:
    return F.from_json(col, "array<string>")


def list_to_json(col: Column) -> Column:
    return F.to_json(col)


def login_key(col: Column) -> Column:
    """Key under which a user is registered: trimmed, lower case."""
    return F.trim(F.lower(col))
