"""Least squares that survive collinear inputs, by orthogonal factors merged up a tree.

Each task reduces its rows ``(1, x, y)`` to the triangular factor of their QR
decomposition; factors are stacked and reduced again, 32 at a time, until one
is left. It has all that least squares need, without the squared condition
number of summed products. Directions in which the inputs do not vary are found
by its singular values after the columns are scaled, and of all solutions the
one with the least norm is returned, so full one-hot columns have coefficients.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MERGED = 32
# Singular values below this share of the largest are zero.
TOLERANCE = 1e-10


def _factors(rows: DataFrame, width: int) -> DataFrame:
    """``(part, cells)``: one triangular factor per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, seen = np.zeros((0, width + 2)), False
        for batch in batches:
            if batch.num_rows:
                seen = True
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                block = np.column_stack([np.ones(len(x)), x, batch.column(1).to_numpy()])
                factor = np.linalg.qr(np.concatenate([factor, block]), mode="r")
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([factor.ravel().tolist()])], names=["part", "cells"])

    return rows.mapInArrow(run, "part long, cells array<double>")


def _merged(parts: DataFrame, width: int) -> DataFrame:
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        stacked = np.concatenate([np.asarray(c).reshape(-1, width + 2) for c in group.sort_values("part")["cells"]])
        return pd.DataFrame({"part": [int(group["part"].min()) // MERGED], "cells": [np.linalg.qr(stacked, mode="r").ravel()]})

    return parts.groupBy(F.floor(F.col("part") / MERGED).alias("group")).applyInPandas(merge, "part long, cells array<double>")


def solve(factor: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Coefficients of least norm, constant and rank, from the factor of ``(1, x, y)``."""
    width = factor.shape[1] - 2
    full = np.zeros((width + 2, width + 2))
    full[:len(factor)] = factor
    # Below the first row stands the factor of the inputs less their means.
    x, y = full[1:, 1:-1], full[1:, -1]
    length = np.sqrt((x * x).sum(axis=0))
    raw = np.sqrt((full[:, 1:-1] ** 2).sum(axis=0))
    # What is left of a constant column is rounding.
    scale = np.where(length > TOLERANCE * raw, length, 1.0)
    u, s, vt = np.linalg.svd(np.where(length > TOLERANCE * raw, x / scale, 0.0), full_matrices=False)
    rank = int((s > TOLERANCE * max(float(s.max(initial=0.0)), 1e-300)).sum())
    found = (vt[:rank].T @ ((u[:, :rank].T @ y) / s[:rank])) / scale
    if rank < width:
        # Whatever the inputs cannot tell apart is taken out in their own scale.
        hidden = np.linalg.svd(vt[:rank], full_matrices=True)[2][rank:] if rank else np.eye(width)
        basis = np.linalg.qr((hidden / scale).T)[0]
        found = found - basis @ (basis.T @ found)
    constant = (full[0, -1] - full[0, 1:-1] @ found) / full[0, 0] if full[0, 0] else 0.0
    return found, float(constant), rank


def fit_linear(train: DataFrame, n_inputs: int) -> LinearModel:
    """On a table with ``features`` and ``label``."""
    rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    parts = durable(_factors(rows, n_inputs), "linear-factors")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        parts = durable(_merged(parts, n_inputs), "linear-factors")
        left = -(-left // MERGED)
    row = parts.first()
    if row is None:
        raise ValueError("there is no training row")
    coefficients, constant, rank = solve(np.asarray(row["cells"]).reshape(-1, n_inputs + 2))
    return LinearModel(DenseVector(coefficients), constant, rank)


class LinearModel:
    def __init__(self, coefficients: DenseVector, intercept: float, rank: int):
        self.coefficients, self.intercept, self.rank = coefficients, intercept, rank

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        products = F.zip_with(vector_to_array("features"), weights, lambda a, b: a * b)
        total = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn("prediction", total + F.lit(self.intercept))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        row = [(self.coefficients.toArray().tolist(), self.intercept, self.rank)]
        spark.createDataFrame(row, "coefficients array<double>, intercept double, rank long").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/linear")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        row = spark.read.parquet(f"{path}/linear").first()
        return cls(DenseVector(row["coefficients"]), row["intercept"], row["rank"])
