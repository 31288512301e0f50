"""Is the target a class or a quantity?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.columns import c, is_integer, is_numeric

# Fixed value: most distinct whole numbers still read as class codes.
MAX_CLASS_CODES = 10

# A coarse sketch: 128 registers, a small aggregation buffer. Values fill at most
# as many registers as there are values, so n of them (n well below 128) give an
# estimate of at most 128 ln(128 / (128 - n)), 16 for n = 15: below 2n for sure.
SKETCH_ERROR = 0.1

CLASSIFICATION, REGRESSION = "classification", "regression"


def problem_type_rule(dtype: T.DataType, rows: int, filled: int, distinct: int) -> str:
    """The rule itself, on facts of one column.

    A whole-number column with missing cells counts as continuous, as it
    would be read as floating point; a complete boolean column is numeric,
    one with missing cells is text.
    """
    if filled == 0:
        return CLASSIFICATION
    if isinstance(dtype, T.BooleanType):
        return REGRESSION if filled == rows else CLASSIFICATION
    if not is_numeric(dtype):
        return CLASSIFICATION
    few_codes = is_integer(dtype) and filled == rows and distinct <= MAX_CLASS_CODES
    return CLASSIFICATION if few_codes else REGRESSION


def bounded_distinct(df: DataFrame, name: str, limit: int) -> int:
    """Exact distinct count when at most ``limit``, else ``limit + 1``.

    The sketch settles wide columns without a shuffle of their values.
    """
    if df.agg(F.approx_count_distinct(c(name), SKETCH_ERROR)).first()[0] > 2 * limit:
        return limit + 1
    return df.select(c(name)).where(c(name).isNotNull()).distinct().limit(limit + 1).count()


def detect_problem_type(df: DataFrame, target: str | None) -> str:
    if target is None:
        return CLASSIFICATION
    if target not in df.columns:
        raise ValueError(f"there is no column {target!r}")
    dtype = df.schema[target].dataType
    row = df.agg(F.count(F.lit(1)), F.count(c(target))).first()
    distinct = 0
    if is_integer(dtype) and row[0] == row[1] > 0:
        distinct = bounded_distinct(df, target, MAX_CLASS_CODES)
    return problem_type_rule(dtype, row[0], row[1], distinct)


def problem_types(df: DataFrame, targets: list[str]) -> DataFrame:
    """``(column, problem_type)`` for several candidate targets.

    One pass counts cells and sketches the whole-number columns; a second one
    lists the values of those that are complete and may be class codes, so no
    column's values are ever exchanged.
    """
    whole = [n for n in targets if is_integer(df.schema[n].dataType)]
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count(c(n)).alias(f"filled_{i}") for i, n in enumerate(targets)]
    aggs += [F.approx_count_distinct(c(n), SKETCH_ERROR).alias(f"sketch_{n}") for n in whole]
    row = df.agg(*aggs).first()
    rows, filled = row["rows"], {n: row[f"filled_{i}"] for i, n in enumerate(targets)}
    distinct = {n: MAX_CLASS_CODES + 1 for n in whole}
    narrow = [n for n in whole if filled[n] == rows > 0 and row[f"sketch_{n}"] <= 2 * MAX_CLASS_CODES]
    if narrow:
        sets = df.agg(*[F.size(F.collect_set(c(n))).alias(f"n_{i}") for i, n in enumerate(narrow)]).first()
        distinct |= {n: sets[f"n_{i}"] for i, n in enumerate(narrow)}
    lines = [(n, problem_type_rule(df.schema[n].dataType, rows, filled[n], distinct.get(n, 0))) for n in targets]
    return df.sparkSession.createDataFrame(lines, "column string, problem_type string")
