"""Categorical columns: drop, label-encode or one-hot; target classes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import c, case_sensitive, text_columns, unique_names
from tabloom.operators.detect import SKETCH_ERROR
from tabloom.session import BROADCAST_ROWS, broadcast_if_small, durable

# Most levels that are one-hot encoded, most that are label-encoded.
MAX_LEVELS = 15
BINARY_LEVELS = 2


@dataclass
class Levels:
    kept: dict[str, list[str]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    onehot_names: dict[str, list[str]] = field(default_factory=dict)

    def binary(self) -> list[str]:
        return [n for n, levels in self.kept.items() if len(levels) <= BINARY_LEVELS]

    def onehot(self) -> list[str]:
        return [n for n, levels in self.kept.items() if len(levels) > BINARY_LEVELS]


def distinct_estimates(columns: list[str]) -> list[Column]:
    return [F.approx_count_distinct(c(n), SKETCH_ERROR) for n in columns]


def surely_above(estimate: int, limit: int) -> bool:
    """True only if more than ``limit`` values are certain (see SKETCH_ERROR)."""
    return estimate > 2 * limit


def fit_levels(df: DataFrame, columns: list[str] | None = None, max_levels: int = MAX_LEVELS,
               estimates: dict[str, int] | None = None) -> Levels:
    """Sorted levels of the columns with at most ``max_levels`` of them.

    A sketch rules out the wide columns in one pass; the survivors' values are
    then counted exactly, so no wide column is ever shuffled.
    """
    names = columns if columns is not None else text_columns(df)
    if not names:
        return Levels()
    if estimates is None:
        row = df.agg(*[e.alias(f"e_{i}") for i, e in enumerate(distinct_estimates(names))]).first()
        estimates = {n: row[f"e_{i}"] for i, n in enumerate(names)}
    narrow = [n for n in names if not surely_above(estimates[n], max_levels)]
    found: dict[str, list[str]] = {}
    if narrow:
        row = df.agg(*[F.collect_set(c(n)).alias(f"s_{i}") for i, n in enumerate(narrow)]).first()
        found = {n: sorted(row[f"s_{i}"]) for i, n in enumerate(narrow)}
    kept = {n: found[n] for n in narrow if len(found[n]) <= max_levels}
    levels = Levels(kept, [n for n in names if n not in kept])
    _name_onehot(levels, [n for n in df.columns if n not in levels.onehot()], case_sensitive(df))
    return levels


def _name_onehot(levels: Levels, others: list[str], sensitive: bool) -> None:
    wanted = [(n, f"{n}_{level}") for n in levels.onehot() for level in levels.kept[n]]
    names = unique_names(others + [w for _, w in wanted], sensitive)[len(others):]
    for (column, _), name in zip(wanted, names):
        levels.onehot_names.setdefault(column, []).append(name)


def level_index(col: Column, levels: list[str]) -> Column:
    """Position in the sorted levels; NULL for an unseen value."""
    out = F.lit(None).cast("long")
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(col == level, F.lit(i).cast("long")).otherwise(out)
    return out


def apply_levels(df: DataFrame, levels: Levels, tail: list[str] | None = None) -> DataFrame:
    """Projection only: binary columns in place, indicator columns last.

    ``tail`` names columns (key, target) to put behind the indicators.
    """
    tail = tail or []
    onehot, binary, dropped = set(levels.onehot()), set(levels.binary()), set(levels.dropped)
    out = []
    for n in df.columns:
        if n in onehot or n in dropped or n in tail:
            continue
        out.append(level_index(c(n), levels.kept[n]).alias(n) if n in binary else c(n))
    for n in levels.onehot():
        for level, name in zip(levels.kept[n], levels.onehot_names[n]):
            out.append(F.coalesce((c(n) == level).cast("long"), F.lit(0)).alias(name))
    return df.select(*out, *[c(n) for n in tail])


def class_table(df: DataFrame, target: str, small: int = BROADCAST_ROWS) -> tuple[DataFrame, list | None]:
    """``(class_index, class_label)`` in sorted order, and the labels if few.

    Few classes are collected and sorted here. Many are range-partitioned and
    numbered by offset plus rank, so that no task sees them all.
    """
    spark = df.sparkSession
    values = df.select(c(target).alias("class_label")).where("class_label IS NOT NULL").distinct()
    label_type = values.schema["class_label"].dataType
    schema = T.StructType([T.StructField("class_index", T.LongType()), T.StructField("class_label", label_type)])
    few = values.limit(small + 1).collect()
    if len(few) <= small:
        labels = sorted(r[0] for r in few)
        return spark.createDataFrame(list(enumerate(labels)), schema), labels
    parts = durable(
        values.repartitionByRange("class_label").withColumn("part", F.spark_partition_id()), "classes")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("class_label"))
    numbered = parts.withColumn("rank", rank).join(offsets, "part").select(
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("class_index"), "class_label")
    return durable(numbered, "class-table"), None


def encode_target(df: DataFrame, target: str, output: str = "label",
                  classes: DataFrame | None = None) -> DataFrame:
    """Add the class index from the class table."""
    if classes is None:
        classes, _ = class_table(df, target)
    side = classes.select(F.col("class_label").alias("__class"), F.col("class_index").alias(output))
    return df.join(broadcast_if_small(side), c(target) == F.col("__class"), "left").drop("__class")


def decode_labels(df: DataFrame, classes: DataFrame, index: str, output: str) -> DataFrame:
    """Class label for a predicted index, by the table and not by position."""
    side = classes.select(F.col("class_index").alias("__index"), F.col("class_label").alias(output))
    return df.join(broadcast_if_small(side), F.col(index).cast("long") == F.col("__index"), "left").drop("__index")
