"""Rounding by the binary value of a double, halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def fixed(value: Column, places: int) -> Column:
    """Text with ``places`` decimals. Unlike ``round`` and ``format_string``, which start from the
    shortest decimal form, 2.675 gives 2.67: the double lies below the half."""
    text = F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places))
    return F.when(value == INFINITE, "inf").when(value == -INFINITE, "-inf").otherwise(text)


def round_half_even(value: Column, places: int) -> Column:
    return F.when(F.abs(value) == INFINITE, value).otherwise(fixed(value, places).try_cast("double"))
