"""Missing cells: drop or fill."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.columns import c, is_numeric
from tabloom.operators.profile import top_values
from tabloom.operators.quantiles import exact_medians

# Strategies, the share (in %) above which a column goes, and
# the text for a text column without any value.
STRATEGIES = ["auto", "median", "drop", "drop_rows"]
DROP_ABOVE_PCT = 50
NO_VALUE = "Unknown"


@dataclass
class Fills:
    """What happens to the missing cells of each column that has some."""

    dropped: dict[str, float] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)
    n_missing: dict[str, int] = field(default_factory=dict)


def missing_facts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c(n)).alias(f"f_{i}") for i, n in enumerate(columns)]).first()
    return row["rows"], {n: row["rows"] - row[f"f_{i}"] for i, n in enumerate(columns)}


def columns_to_drop(rows: int, n_missing: dict[str, int], strategy: str) -> dict[str, float]:
    """Columns the strategy drops, with their missing share (1 decimal)."""
    shares = {n: round(m / rows * 100, 1) for n, m in n_missing.items() if m}
    if strategy == "drop":
        return shares
    if strategy == "auto":
        return {n: pct for n, pct in shares.items() if pct > DROP_ABOVE_PCT}
    return {}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, ties to the smallest."""
    if not columns:
        return {}
    return {r["column"]: r["value"] for r in top_values(df, columns, 1).collect()}


def fit_fills(df: DataFrame, columns: list[str], strategy: str = "auto",
              facts: tuple[int, dict[str, int]] | None = None) -> Fills:
    if strategy not in STRATEGIES:
        raise ValueError(f"missing strategy must be one of {STRATEGIES}, not {strategy!r}")
    rows, n_missing = facts if facts is not None else missing_facts(df, columns)
    n_missing = {n: n_missing[n] for n in columns if n_missing[n]}
    dropped = columns_to_drop(rows, n_missing, strategy)
    if strategy == "drop_rows":
        return Fills(n_missing=n_missing)
    to_fill = [n for n in n_missing if n not in dropped]
    numeric = [n for n in to_fill if is_numeric(df.schema[n].dataType)]
    medians = exact_medians(df, numeric, {n: rows - n_missing[n] for n in numeric})
    found = modes(df, [n for n in to_fill if n not in numeric])
    values: dict[str, object] = {}
    for n in to_fill:
        if n in medians:
            values[n] = medians[n]
        elif isinstance(df.schema[n].dataType, T.BooleanType):
            values[n] = found.get(n) == "true" if n in found else None
        else:
            values[n] = found.get(n, NO_VALUE)
    return Fills(dropped, values, n_missing)


def apply_fills(df: DataFrame, fills: Fills) -> DataFrame:
    """Projection only. A filled whole-number column becomes a double."""

    def one(f: T.StructField):
        if f.name not in fills.values:
            return c(f.name)
        col = c(f.name).cast("double") if is_numeric(f.dataType) else c(f.name)
        value = fills.values[f.name]
        return (col if value is None else F.coalesce(col, F.lit(value))).alias(f.name)

    return df.select([one(f) for f in df.schema if f.name not in fills.dropped])


def drop_incomplete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns if columns is not None else df.columns
    keep = F.lit(True)
    for n in names:
        keep = keep & c(n).isNotNull()
    return df.where(keep)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(c(target).isNotNull())
