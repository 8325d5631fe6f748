"""Type checks on payload text, and the conversions that go with them.

A check on NULL gives NULL, so in a filter it counts as not passed. The
conversions give NULL for text the matching check refuses and never raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings.
_NUMBER = r"(\d+\.?\d*|\.\d+)(e[+-]?\d+)?"
NUMERIC_PATTERN = rf"(?i)^\s*([+-]?{_NUMBER}|nan)\s*$"
FLOAT_PATTERN = rf"(?i)^\s*[+-]?({_NUMBER}|inf(inity)?|nan)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
# A calendar date, optionally a wall-clock time, optionally a zone. Group 1 is
# the wall clock: a zone is accepted and then ignored.
TIMESTAMP_PATTERN = (
    r"^\s*(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?)"
    r"\s*(Z|[+-]\d{2}(:?\d{2})?)?\s*$"
)
TRUE_TEXT = ["t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"]
FALSE_TEXT = ["f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0"]


def to_float(text: Column) -> Column:
    """Text to DOUBLE. Finite spellings too large or too small for a double are refused."""
    parsed = F.trim(text).try_cast("double")
    overflow = (F.abs(parsed) == float("inf")) & ~F.lower(text).contains("inf")
    # The cast knows every accepted spelling but a signed nan.
    underflow = (parsed == 0) & text.rlike(r"^[^eE]*[1-9]")
    refused = F.coalesce(overflow | underflow, F.lit(False))
    return F.when(text.rlike(FLOAT_PATTERN) & ~refused, F.coalesce(parsed, F.lit(float("nan"))))


def is_float(text: Column) -> Column:
    return F.when(text.isNotNull(), to_float(text).isNotNull())


def is_numeric(text: Column) -> Column:
    """Like :func:`is_float`, without infinities and without a size limit."""
    return text.rlike(NUMERIC_PATTERN)


def to_integer(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_PATTERN), F.trim(text).try_cast("bigint"))


def to_wall_clock(text: Column) -> Column:
    """ISO text to TIMESTAMP_NTZ, reading the wall clock and ignoring any zone."""
    clock = F.nullif(F.regexp_extract(text, TIMESTAMP_PATTERN, 1), F.lit(""))
    return clock.try_cast("timestamp_ntz")


def to_instant(text: Column) -> Column:
    """ISO text or epoch milliseconds to TIMESTAMP_NTZ in UTC (the session's zone), honouring a zone if there is one."""
    zoned = F.concat(F.regexp_extract(text, TIMESTAMP_PATTERN, 1), F.regexp_extract(text, TIMESTAMP_PATTERN, 5))
    millis = F.timestamp_millis(F.when(text.rlike(r"^\s*-?\d{5,17}\s*$"), F.trim(text).try_cast("bigint")))
    return F.coalesce(F.nullif(zoned, F.lit("")).try_cast("timestamp"), millis).cast("timestamp_ntz")


def is_timestamp(text: Column) -> Column:
    return F.when(text.isNotNull(), to_wall_clock(text).isNotNull())


def to_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(TRUE_TEXT), True).when(word.isin(FALSE_TEXT), False)


def is_boolean(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(TRUE_TEXT + FALSE_TEXT)


def is_nan(value: Column) -> Column:
    """NULL-preserving, unlike the built-in, which answers false for NULL."""
    return F.when(value.isNotNull(), F.isnan(value))


def taken(predicate: Column) -> Column:
    """A three-valued predicate as the branch decision it leads to."""
    return F.coalesce(predicate, F.lit(False))
