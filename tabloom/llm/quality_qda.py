"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed statistics (logarithms of
counts and of shares). Per class, one aggregate over all labelled rows
gives count, sums and sums of products, hence mean and covariance; nothing is
sampled and no row reaches the driver. A class covariance is drawn towards
the pooled one and towards a multiple of the identity, then factorised once
(Cholesky). The score is the logistic of the difference of the two log
densities, which are Mahalanobis distances by the factors plus their
log-determinants, and of the log-odds of the classes.

Defined results: a null or empty text has a vector like any other (all counts
zero). Without labels of both classes every score is the share of the labels
that are 1 (0 if there are none). A null id is not held out. Repeated rows
give repeated results, an empty table an empty one. Other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import named, numbered_words, slices
from tabloom.llm.compression_bands import duplicate_lines, word_statistics
from tabloom.llm.labelled import held_out, training_labels
from tabloom.session import durable

STATISTICS = ["length", "word_length", "signs", "marks", "capitals", "digits", "line_repeats", "window_repeats",
              "word_repeats", "top_word", "line_length"]

_SIGNS = b"#*$%&|<>{}[]\\^~=_@+/"
_MARKS = b".,;:!?'\"()-"


@dataclass(frozen=True)
class Shrink:
    """Share of the pooled covariance in each class's, and of the identity in the result."""

    pooled: float = 0.5
    identity: float = 0.05


# Shares below this make no difference, so that short texts without any are like long ones.
FLOOR = 0.1


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log(part / np.maximum(whole, 1) + FLOOR)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    batch = [t or "" for t in column.to_pylist()]
    words, repeats = word_statistics(batch)
    _, codes, sizes = numbered_words(pa.array(batch, pa.large_string()))
    doc = np.repeat(np.arange(len(batch)), sizes)
    n_codes = int(codes.max()) + 1 if len(codes) else 1
    pairs, counts = np.unique(doc * n_codes + codes, return_counts=True)
    of = pairs // n_codes
    variety = np.bincount(of, minlength=len(batch))
    top = np.zeros(len(batch), dtype=np.int64)
    np.maximum.at(top, of, counts)
    raw = [t.encode() for t in batch]
    size = np.array([len(t) for t in batch], dtype=float)
    blanks = np.array([sum(map(b.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))) for b in raw], dtype=float)
    chars = size - blanks
    keep = lambda b, allowed: len(b) - len(b.translate(None, allowed))
    signs = np.array([keep(b, _SIGNS) for b in raw], dtype=float)
    marks = np.array([keep(b, _MARKS) for b in raw], dtype=float)
    digits = np.array([keep(b, b"0123456789") for b in raw], dtype=float)
    capitals = np.array([keep(b, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") for b in raw], dtype=float)
    lines = np.array([t.count("\n") + 1 for t in batch], dtype=float)
    repeated = np.array([duplicate_lines(t) for t in batch], dtype=float)
    n = words.astype(float)
    return np.column_stack([
        np.log1p(n), np.log((chars + 1) / (n + 1)), _share(signs, chars), _share(marks, chars),
        _share(np.minimum(capitals, n), n), _share(digits, chars), _share(repeated, lines), _share(repeats, n),
        _share(n - variety, n), _share(np.maximum(top - 1, 0), n), np.log((chars + 1) / lines)])


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor, and the constant of the log density."""

    means: np.ndarray
    roots: np.ndarray
    constants: np.ndarray
    always: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.always is not None:
            return np.full(len(x), self.always)
        logs = [c - 0.5 * (((x - m) @ root.T) ** 2).sum(axis=1)
                for m, root, c in zip(self.means, self.roots, self.constants)]
        return 0.5 * (1 + np.tanh(0.5 * (logs[1] - logs[0])))


def fit_discriminant(moments: list[tuple[float, np.ndarray, np.ndarray]], shrink: Shrink = Shrink()) -> Discriminant:
    """From ``(rows, sums, sums of products)`` of class 0 and class 1."""
    n = np.array([m[0] for m in moments], dtype=float)
    p = len(STATISTICS)
    if min(n) < 2:
        return Discriminant(np.zeros((2, p)), np.zeros((2, p, p)), np.zeros(2), float(n[1] / n.sum()) if n.sum() else 0.0)
    means = [s / k for k, s, _ in moments]
    spread = [q / k - np.outer(m, m) for (k, _, q), m in zip(moments, means)]
    pooled = sum(k * s for k, s in zip(n, spread)) / n.sum()
    scale = np.sqrt(np.diag(pooled)) + 1e-3
    roots, constants = [], []
    for k, s in zip(n, spread):
        mixed = ((1 - shrink.pooled) * s + shrink.pooled * pooled) / np.outer(scale, scale)
        mixed = (1 - shrink.identity) * mixed + shrink.identity * np.trace(mixed) / p * np.eye(p) + 1e-6 * np.eye(p)
        factor = np.linalg.cholesky(mixed)
        roots.append(np.linalg.inv(factor) / scale)
        constants.append(np.log(k / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(roots), np.array(constants))


def statistics_table(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, x)`` of every row."""
    rows = df.select(named(id_column).alias("id"), named(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(STATISTICS)
        for part in slices(batches, 1):
            x = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, p * len(x) + 1, p), pa.int32()),
                                                          pa.array(x.ravel()))], names=["id", "x"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def class_moments(table: DataFrame, known: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Counts, sums and sums of products of both classes, in one aggregate over all labelled rows."""
    p = len(STATISTICS)
    x = [F.col("x")[i] for i in range(p)]
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    rows = {r["label"]: r for r in table.join(known, "id").groupBy("label").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in upper]).collect()}
    out = []
    for label in (0, 1):
        r, sums, products = rows.get(label), np.zeros(p), np.zeros((p, p))
        if r is not None:
            sums[:] = [r[f"s{i}"] for i in range(p)]
            for i, j in upper:
                products[i, j] = products[j, i] = r[f"q{i}_{j}"]
        out.append((r["n"] if r is not None else 0, sums, products))
    return out


def _scorer(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in batches:
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(model.scores(x))], names=["id", "held_out", "score"])

    return run


def score_quality(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
                  label: str = "quality", threshold: float = 0.7, shrink: Shrink = Shrink()) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row."""
    table = durable(statistics_table(df, id_column, text), "statistics")
    model = fit_discriminant(class_moments(table, training_labels(labels, label, id_column)), shrink)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = table.select("id", held_out(F.col("id")).alias("held_out"), "x")
    schema = T.StructType([rows.schema["id"], rows.schema["held_out"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(shared), schema).select(
        F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
