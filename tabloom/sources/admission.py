"""Which files may enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.functions.records import ADMITTED_EXTENSIONS, DEFAULT_LIMIT_MB, admitted_extension, file_extension


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names and sizes; only the listing is read, never the content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select(F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("file_size"))
    )


def table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, file_size)`` of every file or folder directly below ``folder``; a folder has the size of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    last = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.substring_index(F.substring_index("path", f"/{last}/", -1), "/", 1)
    return files.groupBy(name.alias("name")).agg(F.sum("length").alias("file_size"))


def admission_report(
    files: DataFrame,
    name: str = "file_name",
    size: str = "file_size",
    limit_mb: float | None = None,
    extensions: list[str] = ADMITTED_EXTENSIONS,
) -> DataFrame:
    """Verdict and reason per file. The size limit is off unless given."""
    right_kind: Column = admitted_extension(F.col(name), extensions)
    small_enough = F.lit(True) if limit_mb is None else F.col(size) <= F.lit(int(limit_mb * 1024 * 1024))
    return files.select(
        "*",
        file_extension(F.col(name)).alias("extension"),
        (right_kind & small_enough).alias("admitted"),
        F.when(~right_kind, F.lit("extension")).when(~small_enough, F.lit("size")).alias("reason"),
    )


__all__ = ["DEFAULT_LIMIT_MB", "admission_report", "list_files", "table_sizes"]
