"""Cleaning of the all-text input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymatch.config import LANE_RECODES

# Unicode White_Space; a plain trim() removes blanks only.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Decimal and exponent spellings only: a Spark cast would also take a type
# letter ("1.5d") and surrounding blanks.
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"

_DIGITS = "[0-9](_?[0-9])*"
SPOKEN_NUMBER = (
    rf"(?U)^\s*[+-]?(({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))\s*$"
)

SHORT_YEAR = "d/M/yy H:m:s[.SSSSSSSSS]X"
LONG_YEAR = "d/M/yyyy H:m:s[.SSSSSSSSS]X"
ISO = "yyyy-M-d'T'H:m:s[.SSSSSSSSS]'Z'X"


def strip(column: Column) -> Column:
    return F.btrim(column.cast("string"), F.lit(WHITESPACE))


def lane_code(column: Column) -> Column:
    """Stripped lane with the numeric spellings recoded."""
    lane = strip(column)
    codes = F.create_map(*[F.lit(part) for pair in LANE_RECODES.items() for part in pair])
    return F.coalesce(F.element_at(codes, lane), lane)


def lenient_double(df: DataFrame, name: str, column: Column) -> Column:
    """A double, or null where the text is not a number."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return column.cast("double")
    text = column.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def spoken_double(column: Column) -> Column:
    """As ``lenient_double``, but also takes blanks around the number and
    underscores between digits, which interval ends may carry."""
    text = column.cast("string")
    return F.when(text.rlike(SPOKEN_NUMBER), F.translate(strip(text), "_", "").try_cast("double"))


def survey_micros(df: DataFrame, name: str, column: Column) -> Column:
    """Microseconds since 1970 of a naive survey time, null if unreadable.

    The text gets a zone mark of its own before parsing, so the outcome does
    not depend on the session time zone.  The patterns exclude each other; a
    quick look at the text picks the only one that can fit, because a failed
    attempt costs far more than a good one.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    text = column.cast("string")
    marked = F.concat(text, F.lit("Z"))
    read = lambda pattern: F.try_to_timestamp(marked, F.lit(pattern))
    return F.unix_micros(
        F.when(text.contains("T"), read(ISO))
        .when(text.rlike("/[0-9]{4} "), read(LONG_YEAR))
        .when(text.contains("/"), read(SHORT_YEAR))
    )


def finite(column: Column) -> Column:
    """Present, a number and not infinite.  In Spark's order NaN comes after
    infinity, so one comparison covers all three."""
    return F.abs(column) < float("inf")
