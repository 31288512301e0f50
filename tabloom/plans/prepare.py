"""The whole preparation, from a raw table to scaled, split features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabloom.functions.columns import c, is_integer, is_numeric, is_text, normalise
from tabloom.functions.numbers import parse_integer, parse_number, strip_number_format
from tabloom.operators.clean import (
    COPIES,
    NUMERIC_TEXT_RATE,
    ROW_KEY,
    apply_number_format,
    distinct_rows,
    drop_excluded,
    numeric_text_types,
)
from tabloom.operators.detect import MAX_CLASS_CODES, SKETCH_ERROR, bounded_distinct, problem_type_rule
from tabloom.operators.encode import class_table, distinct_estimates, encode_target, fit_levels
from tabloom.operators.impute import apply_fills, drop_incomplete_rows, fit_fills
from tabloom.operators.scale import fit_scaler
from tabloom.operators.split import TEST, TRAIN, Cut, apply_cut, fit_cut
from tabloom.plans.config import PrepConfig
from tabloom.plans.state import PrepState
from tabloom.session import collecting, durable, remove

STEP_SCHEMA = "position long, step string, column string, action string, n_affected long, detail string"


@dataclass
class PrepResult:
    """``data`` holds the row key, the features, the target and ``split``."""

    data: DataFrame
    state: PrepState
    config: PrepConfig
    cut: Cut
    classes: DataFrame | None
    class_labels: list | None
    steps: list[tuple] = field(default_factory=list)
    facts: dict[str, int] = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Remove the intermediate tables; ``data`` and ``classes`` cannot be read any more."""
        remove(self.data.sparkSession, self.tables)

    def train(self) -> DataFrame:
        return self.data.where(F.col("split") == TRAIN)

    def test(self) -> DataFrame:
        return self.data.where(F.col("split") == TEST)

    def summary(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *line) for i, line in enumerate(self.steps)]
        return spark.createDataFrame(rows, STEP_SCHEMA)

    def save(self, folder: str) -> None:
        """Splits and state below ``folder``, which should carry the dataset's id."""
        spark = self.data.sparkSession
        self.data.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/rows")
        self.state.save(spark, f"{folder}/state")
        if self.classes is not None:
            self.classes.write.mode("overwrite").parquet(f"{folder}/classes")


@dataclass
class _Facts:
    rows: int
    copies: int
    filled: dict[str, int]
    rates: list[dict]
    estimates: dict[str, int]


def _facts(base: DataFrame, names: list[str], target: str) -> _Facts:
    """One pass: row counts, missing cells, number rates, cardinality sketches.

    The sketches count only rows that have a target, as encoding will see them.
    """
    text = [n for n in names if is_text(base.schema[n].dataType)]
    sketched = [n for n in text if n != target]
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(COPIES).alias("copies")]
    aggs += [F.count(c(n)).alias(f"filled_{i}") for i, n in enumerate(names)]
    for i, n in enumerate(text):
        cell = strip_number_format(c(n))
        aggs += [F.count(parse_number(cell)).alias(f"number_{i}"), F.count(parse_integer(cell)).alias(f"integer_{i}")]
    aggs += [F.approx_count_distinct(F.when(c(target).isNotNull(), c(n)), SKETCH_ERROR).alias(f"sketch_{i}")
             for i, n in enumerate(sketched)]
    row = base.agg(*aggs).first()
    filled = {n: row[f"filled_{i}"] for i, n in enumerate(names)}
    rates = [
        {"column": n, "n_integers": row[f"integer_{i}"],
         "is_number": filled[n] > 0 and row[f"number_{i}"] / filled[n] > NUMERIC_TEXT_RATE,
         "n_numbers": row[f"number_{i}"]}
        for i, n in enumerate(text)
    ]
    return _Facts(row["rows"], row["copies"] or 0, filled, rates, {n: row[f"sketch_{i}"] for i, n in enumerate(sketched)})


def prepare(df: DataFrame, config: PrepConfig) -> PrepResult:
    """Clean, fill, encode, scale and split a table.

    The result's ``release`` removes the intermediate tables.
    """
    with collecting() as tables:
        prep = _prepare(df, config)
    prep.tables = tables
    return prep


def _prepare(df: DataFrame, config: PrepConfig) -> PrepResult:
    """The steps in order.

    One exchange removes duplicates and its result is written once; all that
    follows is a handful of column-pruned aggregates over that table and, at
    the end, a single projection.
    """
    target, key = config.target, list(config.key)
    raw = normalise(df)
    if target not in raw.columns:
        raise ValueError(f"there is no column {target!r}")
    steps: list[tuple] = []
    kept = drop_excluded(raw, [n for n in config.excluded if n not in key], target)
    for n in raw.columns:
        if n not in kept.columns:
            steps.append(("exclude", n, "dropped", None, None))

    base = durable(distinct_rows(kept, key, [n for n in key if n in config.excluded]), "rows")
    names = [n for n in kept.columns if n not in key]
    facts = _facts(base, names, target)
    steps.insert(0, ("load", None, "read", facts.copies, f"{len(raw.columns)} columns"))
    steps.append(("deduplicate", None, "removed", facts.copies - facts.rows, None))

    number_types = numeric_text_types(facts.rates, facts.rows)
    cleaned = apply_number_format(base, number_types)
    readable = {r["column"]: r["n_numbers"] for r in facts.rates}
    filled = {n: readable[n] if n in number_types else facts.filled[n] for n in names}
    for n, t in number_types.items():
        steps.append(("number_format", n, t, filled[n], None))

    problem = _problem_type(cleaned, config, facts.rows, filled[target])
    steps.append(("problem_type", target, problem, None, None))

    inputs = [n for n in names if n != target]
    missing = {n: facts.rows - filled[n] for n in inputs}
    fills = fit_fills(cleaned, inputs, config.missing_strategy, (facts.rows, missing))
    for n, pct in fills.dropped.items():
        steps.append(("missing", n, "dropped", missing[n], f"{pct}%"))
    for n, value in fills.values.items():
        how = "median" if is_numeric(cleaned.schema[n].dataType) else "mode"
        steps.append(("missing", n, how, missing[n], f"{value:.4g}" if how == "median" and value is not None else str(value)))
    complete = cleaned
    if config.missing_strategy == "drop_rows":
        complete = drop_incomplete_rows(cleaned, inputs)
        steps.append(("missing", None, "rows dropped", facts.rows - complete.count(), None))
    n_unlabelled = facts.rows - filled[target]
    if n_unlabelled:
        complete = complete.where(c(target).isNotNull())
        steps.append(("missing", target, "rows dropped", n_unlabelled, None))

    state = PrepState(target, problem, {n: base.schema[n].dataType.simpleString() for n in inputs}, number_types, fills)
    full = apply_fills(complete.select(*[c(n) for n in inputs], ROW_KEY, c(target)), fills)
    text = [n for n in full.columns if n in inputs and is_text(full.schema[n].dataType)]
    sketches = {n: facts.estimates[n] for n in text}
    if text and (target in number_types or config.missing_strategy == "drop_rows"):
        row = full.agg(*[e.alias(f"e_{i}") for i, e in enumerate(distinct_estimates(text))]).first()
        sketches = {n: row[f"e_{i}"] for i, n in enumerate(text)}
    state.levels = fit_levels(full, text, estimates=sketches)
    for n in text:
        if n in state.levels.dropped:
            steps.append(("encode", n, "dropped", None, "high cardinality"))
        else:
            how = "label" if n in state.levels.binary() else "one-hot"
            steps.append(("encode", n, how, len(state.levels.kept[n]), ",".join(state.levels.kept[n])))

    encoded = state.apply(complete, keep=[ROW_KEY, target], scale=False)
    state.features = [n for n in encoded.columns if n not in (ROW_KEY, target)]
    cut = fit_cut(complete, F.col(ROW_KEY), config.test_size, config.seed)
    if config.scale_method == "standard":
        numeric = [n for n in state.features if is_numeric(encoded.schema[n].dataType)]
        scale_rows = encoded
        if config.scale_on == "train":
            scale_rows = apply_cut(encoded, F.col(ROW_KEY), cut, config.seed).where(F.col("split") == TRAIN)
        state.scaler = fit_scaler(scale_rows, numeric)
        for n in state.scaler:
            steps.append(("scale", n, "standard", None, None))

    if problem == "classification" and not (is_text(cleaned.schema[target].dataType)
                                            or is_integer(cleaned.schema[target].dataType)):
        complete = complete.withColumn(target, c(target).cast("string"))
    data = state.apply(complete, keep=[ROW_KEY, target])
    classes = labels = None
    if problem == "classification":
        classes, labels = class_table(complete, target)
        data = encode_target(data, target, "label", classes)
        n_classes = len(labels) if labels is not None else classes.count()
        listed = ",".join(map(str, labels)) if labels is not None else None
        steps.append(("encode", target, "label (target)", n_classes, listed))
    else:
        data = data.withColumn("label", _as_number(c(target), complete.schema[target].dataType))
    data = apply_cut(data, F.col(ROW_KEY), cut, config.seed)
    steps.append(("split", None, "train/test", cut.n_rows, f"{cut.n_rows - cut.n_test}/{cut.n_test}"))
    counted = {"n_read": facts.copies, "n_columns": len(raw.columns), "n_copies": facts.copies - facts.rows}
    return PrepResult(data, state, config, cut, classes, labels, steps, counted)


def _as_number(col, dtype):
    if isinstance(dtype, T.StringType):
        return parse_number(strip_number_format(col))
    return col.cast("double")


def _problem_type(df: DataFrame, config: PrepConfig, rows: int, filled: int) -> str:
    """The chosen problem type is honoured; ``auto`` looks at the target."""
    if config.problem_type != "auto":
        return config.problem_type
    dtype = df.schema[config.target].dataType
    distinct = 0
    if is_integer(dtype) and filled == rows > 0:
        distinct = bounded_distinct(df, config.target, MAX_CLASS_CODES)
    return problem_type_rule(dtype, rows, filled, distinct)
