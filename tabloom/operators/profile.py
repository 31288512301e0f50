"""What is in a table: shape, types, missing cells, statistics, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabloom.functions.columns import c, is_boolean, is_integer, is_numeric, text_columns
from tabloom.functions.numbers import percent
from tabloom.session import broadcast_if_small, durable


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def preview(df: DataFrame, order_by: list, n: int = 10) -> DataFrame:
    """First rows in a stated order; a DataFrame has none of its own."""
    return df.orderBy(*order_by).limit(n)


def column_types(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), is_numeric(f.dataType) or is_boolean(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position long, column string, dtype string, is_numeric boolean")


def measured_columns(df: DataFrame) -> list[str]:
    """Columns with a mean: numbers, and booleans as 0 and 1."""
    return [f.name for f in df.schema if is_numeric(f.dataType) or is_boolean(f.dataType)]


def _measured(df: DataFrame, name: str):
    return c(name).cast("int") if is_boolean(df.schema[name].dataType) else c(name)


def type_summary(types: DataFrame) -> DataFrame:
    numeric = F.col("is_numeric").cast("long")
    return types.agg(
        F.count_distinct("dtype").alias("n_dtypes"),
        F.sum(numeric).alias("n_numeric"),
        F.sum(1 - numeric).alias("n_categorical"),
    )


def missing(df: DataFrame) -> DataFrame:
    """Missing cells per column from a single aggregate row, turned long."""
    names = df.columns
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c(n)).alias(f"filled_{i}") for i, n in enumerate(names)])
    rows = F.col("rows")
    lines = [
        F.struct(
            F.lit(n).alias("column"),
            (rows - F.col(f"filled_{i}")).alias("n_missing"),
            percent(rows - F.col(f"filled_{i}"), rows).alias("missing_pct"),
        )
        for i, n in enumerate(names)
    ]
    return facts.select(F.inline(F.array(*lines)))


def missing_total(df: DataFrame) -> DataFrame:
    return missing(df).agg(F.sum("n_missing").alias("total_missing"))


def missing_ranked(df: DataFrame) -> DataFrame:
    """Columns with missing cells, most first."""
    return missing(df).where("n_missing > 0").orderBy(F.desc("n_missing"), "column")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact ``(column, n_distinct)`` of numeric and boolean columns.

    Cells are counted once per (column, value) inside each task before the
    exchange. Whole numbers and doubles are kept apart so no digit is lost.
    """
    whole = [n for n in columns if is_integer(df.schema[n].dataType)]
    out = None
    for names, kind in ((whole, "long"), ([n for n in columns if n not in whole], "double")):
        if not names:
            continue
        cells = df.select([_measured(df, n).cast(kind).alias(n) for n in names]).unpivot([], [c(n) for n in names], "column", "value")
        one = cells.where("value IS NOT NULL").groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(
            F.count("*").alias("n_distinct"))
        out = one if out is None else out.unionByName(one)
    return out


def numeric_statistics(df: DataFrame, columns: list[str] | None = None, digits: int = 4,
                       exact_distinct: bool = True) -> DataFrame:
    """Missing cells, distinct values, mean, deviation, range per column.

    Exact distinct counts exchange every column's values; with
    ``exact_distinct=False`` a sketch leaves one row per task to exchange.
    """
    names = columns if columns is not None else measured_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        v = _measured(df, n)
        aggs += [
            F.count(v).alias(f"filled_{i}"),
            (F.lit(0) if exact_distinct else F.approx_count_distinct(v)).cast("long").alias(f"distinct_{i}"),
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_samp(v).alias(f"std_{i}"),
            F.min(v).cast("double").alias(f"min_{i}"),
            F.max(v).cast("double").alias(f"max_{i}"),
        ]
    rows = F.col("rows")
    lines = [
        F.struct(
            F.lit(n).alias("column"),
            (rows - F.col(f"filled_{i}")).alias("n_missing"),
            percent(rows - F.col(f"filled_{i}"), rows).alias("missing_pct"),
            F.col(f"distinct_{i}").alias("n_distinct"),
            *[F.bround(f"{s}_{i}", digits).alias(s) for s in ("mean", "std", "min", "max")],
        )
        for i, n in enumerate(names)
    ]
    out = df.agg(*aggs).select(F.inline(F.array(*lines)))
    if not exact_distinct or not names:
        return out
    exact = distinct_counts(df, names).withColumnRenamed("n_distinct", "__exact")
    return out.join(exact, "column", "left").withColumn("n_distinct", F.coalesce("__exact", F.lit(0))).drop("__exact")


# Characters of a value that are counted as they are; of a longer one they travel with its digest, to order ties.
PREFIX = 32


def _text_cells(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """``(column, value, prefix, size)`` of all filled text cells."""
    names = columns if columns is not None else text_columns(df)
    cells = df.select([c(n).cast("string").alias(n) for n in names]).unpivot([], [c(n) for n in names], "column", "value")
    return cells.where(F.col("value").isNotNull()).withColumns(
        {"prefix": F.substring("value", 1, PREFIX), "size": F.char_length("value")})


def _digest():
    return F.unhex(F.md5("value"))


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, prefix, size, digest, n)`` for all text columns in one shuffle, which no long value goes through.

    Only values longer than their prefix have a digest.
    """
    cells = _text_cells(df, columns).withColumn("digest", F.when(F.col("size") > PREFIX, _digest()))
    return cells.groupBy("column", "prefix", "size", "digest").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 3) -> DataFrame:
    """``(column, value, n, rank)``: most frequent values per column; ties by value.

    Short values are counted as they are, long ones by digest; values that tie
    in count and prefix stay together. Only the few long winners are looked up,
    among the cells that share their prefix and length, so no other text is
    hashed again. The rank test lets Spark keep k places per column in each task
    before the exchange, so a column of unique texts does not meet in one task.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), "prefix")
    places = value_frequencies(df, columns).withColumn("place", F.rank().over(order)).where(F.col("place") <= k)
    places = durable(places, "top-digests")
    values = places.where("digest IS NULL").select("column", "n", F.col("prefix").alias("value"))
    long = places.where("digest IS NOT NULL").select("column", "prefix", "size", "digest", "n")
    names = [r["column"] for r in long.select("column").distinct().collect()]
    if names:
        cells = _text_cells(df, names).where(F.col("size") > PREFIX)
        found = cells.join(broadcast_if_small(long), ["column", "prefix", "size"]).where(_digest() == F.col("digest"))
        values = values.unionByName(
            found.groupBy("column", "digest", "n").agg(F.first("value").alias("value")).select("column", "n", "value"))
    exact = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = values.withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= k)
    return ranked.select("column", "value", "n", F.col("rank").cast("long").alias("rank"))


def text_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return value_frequencies(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_filled"))


def search_columns(profile: DataFrame, needle: str) -> DataFrame:
    """Profile rows whose column name contains ``needle``, any case."""
    return profile.where(F.lower("column").contains(needle.lower().strip()))
