"""Small scalar expressions shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_day(table: DataFrame) -> DataFrame:
    """Mark a table with one row per calendar day as the broadcast side of a join.

    Its size is bounded by the length of market history (some ten thousand rows per forty years), not
    by the data. Without the mark the planner may pick the panel as the broadcast side, because it
    does not see that an explode multiplies rows, and the single partition of a day table would then
    carry the whole panel.
    """
    return F.broadcast(table)


def normal_symbol(col: Column | str) -> Column:
    """Share classes use '-' here where exchanges use '.': 'brk.b' -> 'BRK-B'."""
    return F.replace(F.upper(F.trim(col)), F.lit("."), F.lit("-"))


def exchange_symbol(col: Column | str) -> Column:
    """The inverse spelling: 'BRK-B' -> 'BRK.B'."""
    return F.replace(F.upper(F.trim(col)), F.lit("-"), F.lit("."))


def finite_or_null(col: Column | str) -> Column:
    """NaN is a missing value everywhere in this library."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(col), col)


def is_infinite(col: Column) -> Column:
    return F.abs(col) == F.lit(float("inf"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is null or zero."""
    return F.try_divide(num, den)


def utc_wall_clock(col: Column | str) -> Column:
    """A zone-free UTC timestamp. Text may carry an offset or Z and is moved to UTC; text that is no time becomes null.
    Instants are read in the session zone, which must be UTC."""
    col = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(col.cast("string")).cast("timestamp_ntz")
