"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.batches import named

# Rows whose id has this remainder are held out.
FOLDS = 4
HELD_OUT = 2


def held_out(id_column: Column) -> Column:
    """True for rows that no label is learned from; a null id has the checksum of an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def training_labels(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """``(id, label)``, one row per id that may be learned from; of contradicting labels the larger counts."""
    rows = labels.select(named(id_column).alias("id"), named(label).cast("int").alias("label"))
    return rows.where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(
        F.max("label").alias("label"))
