"""Text to number conversion with the rules of the usual CSV readers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters removed from formatted numbers, and what a number
# looks like. ``\s`` is space, tab, line breaks, form feed and vertical tab.
FORMAT_CHARACTERS = ["$", "%", ","]
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
NOT_A_NUMBER = r"(?i)^\s*[+-]?nan\s*$"


def strip_number_format(col: Column) -> Column:
    """``$1,200`` -> ``1200``, ``12 %`` -> ``12 ``; the parsers skip blanks."""
    for character in FORMAT_CHARACTERS:
        col = F.replace(col, F.lit(character))
    return col


def parse_number(col: Column) -> Column:
    """Decimal or scientific notation, or an infinity; everything else NULL.

    The pattern comes first because a plain cast also accepts ``1d``, ``1.5f``
    and ``NaN``, and because a failing cast costs an exception per cell.
    """
    value = col.try_cast("double")
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    infinite = F.when(col.contains("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(col.rlike(NUMBER), finite).when(col.rlike(INFINITE), infinite)


def parse_integer(col: Column) -> Column:
    return F.when(col.rlike(INTEGER), col.try_cast("long"))


def parse_typed_number(col: Column) -> Column:
    """A number as a person may type it: ``_`` may group digits, NaN counts."""
    text = col.cast("string")
    grouped = F.when(text.contains("_"), F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")).otherwise(text)
    return F.when(text.rlike(NOT_A_NUMBER), F.lit(float("nan"))).otherwise(parse_number(grouped))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, half-even rounding; 0 for an empty table."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.bround(share, digits), F.lit(0.0))
