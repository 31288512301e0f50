"""Standard scaling with the population deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import c, numeric_columns

METHODS = ["standard", "none"]


def fit_scaler(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """Mean and deviation per column from one aggregate row."""
    names = columns if columns is not None else numeric_columns(df)
    if not names:
        return {}
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.avg(c(n)).alias(f"m_{i}"), F.stddev_pop(c(n)).alias(f"s_{i}")]
    row = df.agg(*aggs).first()
    return {n: (row[f"m_{i}"], row[f"s_{i}"]) for i, n in enumerate(names) if row[f"m_{i}"] is not None}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Projection only. A constant column is centred and divided by one."""
    return df.select([
        ((c(n) - F.lit(scaler[n][0])) / F.lit(scaler[n][1] or 1.0)).alias(n) if n in scaler else c(n)
        for n in df.columns
    ])
