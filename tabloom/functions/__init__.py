from tabloom.functions.columns import c, is_integer, is_numeric, is_text, numeric_columns, text_columns, unique_names
from tabloom.functions.numbers import parse_integer, parse_number, percent, strip_number_format

__all__ = [
    "c", "is_integer", "is_numeric", "is_text", "numeric_columns", "text_columns", "unique_names",
    "parse_integer", "parse_number", "percent", "strip_number_format",
]
