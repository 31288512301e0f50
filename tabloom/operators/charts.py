"""The numbers behind the usual charts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import c, numeric_columns
from tabloom.operators.profile import missing_ranked

# Fixed value: bars of the target histogram.
HISTOGRAM_BINS = 20
# Columns of a block; a task holds six sums for every pair of two blocks.
BLOCK_COLUMNS = 512
# Variance of standardised values below which a column counts as constant.
VARIES = 1e-12


@dataclass(frozen=True)
class _Column:
    """What one aggregate pass tells about a column."""

    name: str
    complete: bool
    constant: bool
    mean: float
    std: float

    def z(self) -> Column:
        return (c(self.name).cast("double") - F.lit(self.mean)) / F.lit(self.std)


def _column_facts(df: DataFrame, names: list[str]) -> dict[str, _Column]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        v = c(n).cast("double")
        aggs += [F.count(v).alias(f"n_{i}"), F.min(v).alias(f"lo_{i}"), F.max(v).alias(f"hi_{i}"),
                 F.avg(v).alias(f"m_{i}"), F.stddev_pop(v).alias(f"s_{i}")]
    r = df.agg(*aggs).first()
    return {
        n: _Column(n, r[f"n_{i}"] == r["rows"], r[f"n_{i}"] == 0 or r[f"lo_{i}"] == r[f"hi_{i}"], r[f"m_{i}"], r[f"s_{i}"])
        for i, n in enumerate(names)
    }


def _pair_aggregate(x: Column, y: Column, complete: bool) -> Column:
    """Correlation of two standardised columns over complete pairs.

    Without gaps it is the mean product. With gaps the pair's own moments
    enter; a column constant over the pair gives NULL.
    """
    if complete:
        return F.avg(x * y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    n = F.count(x * y).cast("double")
    sxy = F.sum(x * y) - F.try_divide(F.sum(a) * F.sum(b), n)
    sxx = F.sum(a * a) - F.try_divide(F.sum(a) * F.sum(a), n)
    syy = F.sum(b * b) - F.try_divide(F.sum(b) * F.sum(b), n)
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy)))


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]], facts: dict[str, _Column] | None = None) -> DataFrame:
    """``(a, b, r)`` per pair: column facts first, then one more pass.

    The second pass sums products of standardised values, which stays in
    generated code; NULL where a column is constant, as no correlation exists.
    """
    facts = facts or _column_facts(df, list(dict.fromkeys(n for p in pairs for n in p)))
    used = [f for f in facts.values() if not f.constant]
    position = {f.name: i for i, f in enumerate(used)}
    z = df.select([f.z().alias(f"z{i}") for i, f in enumerate(used)])
    aggs, lines = [F.count(F.lit(1)).alias("rows")], []
    for k, (a, b) in enumerate(pairs):
        if a not in position or b not in position:
            r = F.lit(None).cast("double")
        elif a == b:
            r = F.lit(1.0)
        else:
            x, y = F.col(f"z{position[a]}"), F.col(f"z{position[b]}")
            aggs.append(_pair_aggregate(x, y, facts[a].complete and facts[b].complete).alias(f"r_{k}"))
            r = F.col(f"r_{k}")
            r = F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
        lines.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return z.agg(*aggs).select(F.inline(F.array(*lines)))


def _pair_sums(n_left: int):
    """Partial sums over complete pairs of left and right columns, one row per pair and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = np.column_stack([col.to_numpy(zero_copy_only=False).astype(float) for col in batch.columns])
            filled = ~np.isnan(z)
            z = np.where(filled, z, 0.0)
            left, right = z[:, :n_left], z[:, n_left:]
            has_left, has_right = filled[:, :n_left].astype(float), filled[:, n_left:].astype(float)
            part = np.stack([has_left.T @ has_right, left.T @ right, left.T @ has_right, has_left.T @ right,
                             (left * left).T @ has_right, has_left.T @ (right * right)])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel()), pa.array(j.ravel()), *[pa.array(s.ravel()) for s in total]], names=["i", "j", *_SUMS])

    return run


_SUMS = ["n", "xy", "x", "y", "xx", "yy"]


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Full matrix as ``(a, b, r)`` rows, over the complete rows of each pair.

    Every task sums up products of standardised values for whole blocks of
    columns, so one pass serves up to ``BLOCK_COLUMNS`` squared pairs, gaps or
    not. NULL where a column does not vary over the pair.
    """
    names = columns if columns is not None else numeric_columns(df)
    facts = _column_facts(df, names)
    used = [n for n in names if not facts[n].constant]
    blocks = [used[k:k + BLOCK_COLUMNS] for k in range(0, len(used), BLOCK_COLUMNS)]
    spark = df.sparkSession
    out = None
    for a in range(len(blocks)):
        for b in range(a, len(blocks)):
            part = _block_correlations(df, facts, blocks[a], blocks[b], a != b)
            out = part if out is None else out.unionByName(part)
    fixed = [(a, b, None) for a in names for b in names if facts[a].constant or facts[b].constant]
    rest = spark.createDataFrame(fixed, "a string, b string, r double")
    return rest if out is None else out.unionByName(rest)


def _block_correlations(df: DataFrame, facts: dict[str, _Column], left: list[str], right: list[str], mirror: bool) -> DataFrame:
    z = df.select(*[facts[n].z().alias(f"l{i}") for i, n in enumerate(left)], *[facts[n].z().alias(f"r{i}") for i, n in enumerate(right)])
    sums = z.mapInArrow(_pair_sums(len(left)), "i long, j long, " + ", ".join(f"{s} double" for s in _SUMS))
    total = sums.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    sxx = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), F.col("n"))
    syy = F.col("yy") - F.try_divide(F.col("y") * F.col("y"), F.col("n"))
    r = F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n")), F.sqrt(sxx) * F.sqrt(syy))
    # Standardised values: what is left of a constant is rounding.
    varied = (sxx > VARIES * F.col("n")) & (syy > VARIES * F.col("n"))
    r = F.when(varied, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
    a = F.element_at(F.array(*map(F.lit, left)), (F.col("i") + 1).cast("int"))
    b = F.element_at(F.array(*map(F.lit, right)), (F.col("j") + 1).cast("int"))
    pairs = total.select(a.alias("a"), b.alias("b"), r.alias("r")).withColumn("r", F.when((F.col("a") == F.col("b")) & F.col("r").isNotNull(), F.lit(1.0)).otherwise(F.col("r")))
    if not mirror:
        return pairs
    return pairs.select(F.inline(F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over the range, empty ones included.

    The last bin holds the maximum; a constant column gets a range of one
    around its value.
    """
    v = c(column).cast("double")
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin long, lo double, hi double, n long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = df.where(v.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("hi"),
    )
    return frame.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def correlation_importance(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """|correlation| with the target: an importance that needs no model."""
    names = [n for n in (features or numeric_columns(df)) if n != target]
    found = pair_correlations(df, [(n, target) for n in names])
    return found.select(F.col("a").alias("feature"), F.abs("r").alias("importance")).orderBy(
        F.desc_nulls_last("importance"), "feature")


__all__ = ["correlation_importance", "correlation_matrix", "histogram", "missing_ranked", "pair_correlations", "value_counts"]
