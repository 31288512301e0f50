"""RBF-kernel SVM as a linear SVM on random Fourier features.

Rahimi and Recht, "Random Features for Large-Scale Kernel Machines" (NIPS
2007). The feature map is a small matrix product per Arrow batch; training is
``LinearSVC``, one-vs-rest for more than two classes. It scales with the rows,
so there is no limit on them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


# Fixed value: relative change at which training stops.
TOLERANCE = 1e-5
# Rows whose features, 2 KB each, one task keeps.
TASK_ROWS = 1 << 15


@dataclass(frozen=True)
class FourierMap:
    """Random frequencies follow from these numbers alone."""

    n_inputs: int
    n_features: int
    gamma: float
    seed: int

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0.0, np.sqrt(2.0 * self.gamma), (self.n_inputs, self.n_features))
        return w, rng.uniform(0.0, 2.0 * np.pi, self.n_features)

    def transform(self, df: DataFrame, inputs: str = "features", output: str = "fourier") -> DataFrame:
        w, b = self.weights()
        norm = np.sqrt(2.0 / self.n_features)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(vectors: pd.Series) -> pd.Series:
            if vectors.empty:
                return vectors
            return pd.Series(list(norm * np.cos(np.stack(vectors.to_numpy()) @ w + b)))

        return df.withColumn(output, array_to_vector(project(vector_to_array(inputs))))


def scale_gamma(df: DataFrame, n_inputs: int, inputs: str = "features") -> float:
    """1 / (inputs x variance of all cells), from one aggregate."""
    cells = vector_to_array(inputs)
    zero = F.lit(0.0)
    row = df.agg(
        F.avg(F.aggregate(cells, zero, lambda acc, x: acc + x)).alias("total"),
        F.avg(F.aggregate(cells, zero, lambda acc, x: acc + x * x)).alias("squares"),
    ).first()
    variance = row["squares"] / n_inputs - (row["total"] / n_inputs) ** 2
    return 1.0 / (n_inputs * variance) if variance > 0 else 1.0


class KernelSvm:
    """Estimator with ``fit``; the model has ``transform``, ``save``, ``load``."""

    def __init__(self, n_features: int = 256, penalty: float = 1.0, seed: int = 42, max_iter: int = 100):
        self.n_features, self.penalty, self.seed, self.max_iter = n_features, penalty, seed, max_iter

    def fit(self, df: DataFrame, n_classes: int, n_rows: int, n_inputs: int) -> KernelSvmModel:
        gamma = scale_gamma(df, n_inputs)
        mapping = FourierMap(n_inputs, self.n_features, gamma, self.seed)
        svc = LinearSVC(featuresCol="fourier", labelCol="label", maxIter=self.max_iter, standardization=False,
                        tol=TOLERANCE, regParam=1.0 / (self.penalty * n_rows))
        rows = df.select("features", "label")
        if n_rows > TASK_ROWS:
            # A file of few row groups would else be one task's, with all its features.
            rows = rows.repartition(-(-n_rows // TASK_ROWS))
        # The solver itself keeps the features, in blocks.
        data = mapping.transform(rows).select("fourier", "label")
        if n_classes > 2:
            many = OneVsRest(classifier=svc, featuresCol="fourier", labelCol="label", parallelism=min(n_classes, 4))
            return KernelSvmModel(mapping, many.fit(data))
        return KernelSvmModel(mapping, svc.fit(data))


class KernelSvmModel:
    def __init__(self, mapping: FourierMap, linear):
        self.mapping, self.linear = mapping, linear

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.linear.transform(self.mapping.transform(df))
        return scored.drop("fourier", "rawPrediction")

    def save(self, path: str) -> None:
        self.linear.write().overwrite().save(f"{path}/linear")
        spark = SparkSession.getActiveSession()
        kind = "many" if isinstance(self.linear, OneVsRestModel) else "two"
        spark.createDataFrame([(kind, json.dumps(asdict(self.mapping)))], "kind string, mapping string").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/mapping")

    @classmethod
    def load(cls, spark, path: str) -> KernelSvmModel:
        row = spark.read.parquet(f"{path}/mapping").first()
        loader = OneVsRestModel if row["kind"] == "many" else LinearSVCModel
        return cls(FourierMap(**json.loads(row["mapping"])), loader.load(f"{path}/linear"))
