"""Reproducible train/test split of an exact size, without a global sort."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

STEP = 4
SMALL_BUCKET = 10_000

TRAIN, TEST = "train", "test"


@dataclass(frozen=True)
class Cut:
    """All rows whose digest is at most ``digest`` are test rows."""

    digest: str
    n_rows: int
    n_test: int


def key_digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key))


def n_test_rows(n_rows: int, test_size: float) -> int:
    if not 0 < test_size < 1:
        raise ValueError("the test share must lie between 0 and 1")
    return min(n_rows, math.ceil(n_rows * test_size))


def fit_cut(df: DataFrame, key: Column, test_size: float = 0.2, seed: int = 42) -> Cut:
    """Find the digest of the last test row.

    Digests are counted by their first four hex digits: at most 65,536 counts,
    whose running sum names the bucket the cut falls into. Only that bucket is
    looked at again, by its next digits, until its few digests can be listed.
    Every pass reads the key column alone, and no task ranks the table.
    """
    digests = df.select(key_digest(key, seed).alias("d"))
    prefix, below, n_rows, wanted, size = "", 0, None, None, None
    while size is None or (size > SMALL_BUCKET and len(prefix) < 32):
        piece = F.substring("d", len(prefix) + 1, STEP)
        counts = digests.where(F.col("d").startswith(prefix)).groupBy(piece.alias("p")).agg(F.count("*").alias("n"))
        buckets = sorted((r["p"], r["n"]) for r in counts.collect())
        if n_rows is None:
            n_rows = sum(n for _, n in buckets)
            wanted = n_test_rows(n_rows, test_size)
            if wanted == 0:
                return Cut("", n_rows, 0)
        for p, n in buckets:
            if below + n >= wanted:
                prefix, size = prefix + p, n
                break
            below += n
    if len(prefix) >= 32:
        if below + size != wanted:
            raise ValueError("the split needs a unique row key")
        return Cut(prefix, n_rows, wanted)
    inside = sorted(r["d"] for r in digests.where(F.col("d").startswith(prefix)).collect())
    at = wanted - below
    if at < len(inside) and inside[at] == inside[at - 1]:
        raise ValueError("the split needs a unique row key")
    return Cut(inside[at - 1], n_rows, wanted)


def apply_cut(df: DataFrame, key: Column, cut: Cut, seed: int = 42, output: str = "split") -> DataFrame:
    """Projection only."""
    is_test = key_digest(key, seed) <= F.lit(cut.digest)
    return df.withColumn(output, F.when(is_test, F.lit(TEST)).otherwise(F.lit(TRAIN)))


def split_exact(df: DataFrame, key: Column, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    return apply_cut(df, key, fit_cut(df, key, test_size, seed), seed)
