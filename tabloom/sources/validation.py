"""Is a table fit to be analysed?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import c

# The smallest table accepted.
MIN_ROWS = 3
MIN_COLUMNS = 2


def validation_rules(df: DataFrame) -> DataFrame:
    """Rule table ``(rule, ok, detail)`` from one aggregate over all columns."""
    names = df.columns
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c(n)).alias(f"filled_{i}") for i, n in enumerate(names)])
    empty_columns = F.array_compact(
        F.array(*[F.when(F.col(f"filled_{i}") == 0, F.lit(n)) for i, n in enumerate(names)])
    )
    n_rows, n_cols = F.col("rows"), F.lit(len(names))

    def rule(name, ok, detail):
        return F.struct(F.lit(name).alias("rule"), ok.alias("ok"), detail.cast("string").alias("detail"))

    rules = [
        rule("not_empty", (n_rows > 0) & (n_cols > 0), n_rows),
        rule("enough_rows", n_rows >= MIN_ROWS, n_rows),
        rule("enough_columns", n_cols >= MIN_COLUMNS, n_cols),
        rule("no_empty_column", F.size(empty_columns) == 0, F.array_join(empty_columns, ",")),
    ]
    return facts.select(F.inline(F.array(*rules)))


def require_valid(df: DataFrame) -> DataFrame:
    """Return ``df``, or raise ``ValueError`` naming the first broken rule."""
    wording = {
        "not_empty": "the table has no rows",
        "enough_rows": f"the table needs at least {MIN_ROWS} rows",
        "enough_columns": f"the table needs at least {MIN_COLUMNS} columns",
        "no_empty_column": "some column has no value at all",
    }
    verdict = {r["rule"]: r for r in validation_rules(df).collect()}
    for rule, text in wording.items():
        if not verdict[rule]["ok"]:
            raise ValueError(f"{text} (found: {verdict[rule]['detail'] or 'none'})")
    return df


def require_config(columns: list[str], target: str | None, excluded: list[str]) -> None:
    """The target must be named, exist and not be excluded."""
    if not target:
        raise ValueError("no target column chosen")
    if target not in columns:
        raise ValueError(f"there is no column {target!r}")
    if target in excluded:
        raise ValueError(f"the target {target!r} cannot be excluded")


# Reasons for refusing a configuration.
NO_TARGET, UNKNOWN_TARGET, EXCLUDED_TARGET = "no target", "unknown target", "target excluded"


def config_reasons(configs: DataFrame, columns: list[str], target: str = "target_column",
                   excluded: str = "excluded_columns") -> DataFrame:
    """Stored configurations of one table with the ``reason`` each is refused for, NULL if it holds."""
    name = F.col(target)
    return configs.withColumn("reason", F.when(name.isNull() | (name == ""), F.lit(NO_TARGET))
                              .when(~name.isin(columns), F.lit(UNKNOWN_TARGET))
                              .when(F.array_contains(excluded, name), F.lit(EXCLUDED_TARGET)))


def input_feature_table(configs: DataFrame, columns: list[str], show: int = 6, target: str = "target_column",
                        excluded: str = "excluded_columns") -> DataFrame:
    """Per stored configuration the columns left as inputs: their count, the first few, how many more."""
    left = F.filter(F.array(*map(F.lit, columns)), lambda n: ~(n.eqNullSafe(F.col(target)) | F.array_contains(excluded, n)))
    return configs.withColumn("left", left).select(
        "*", F.size("left").cast("long").alias("n_inputs"), F.array_join(F.slice("left", 1, show), ",").alias("first_inputs"),
        F.greatest(F.size("left") - show, F.lit(0)).cast("long").alias("n_more")).drop("left")


def input_features(columns: list[str], target: str, excluded: list[str], show: int = 6) -> dict:
    """Columns left as inputs: their count, the first few, how many more."""
    left = [n for n in columns if n != target and n not in set(excluded)]
    return {"count": len(left), "first": left[:show], "more": max(0, len(left) - show)}
