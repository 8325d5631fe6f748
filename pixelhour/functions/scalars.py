"""Small numeric, text and array expressions used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the output time format.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso_text(clock: Column) -> Column:
    """Whole seconds; a fraction is cut off. TIMESTAMP values need a UTC session."""
    return F.date_format(clock, ISO_FORMAT)


def pixel_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def scalar_max(a: Column, b: Column) -> Column:
    """The larger of the two; a NULL side is skipped."""
    return F.greatest(a, b)


def scalar_min(a: Column, b: Column) -> Column:
    return F.least(a, b)


def combined_mean(mean1: Column, mean2: Column, n1: Column, n2: Column) -> Column:
    return (mean1 * n1 + mean2 * n2) / (n1 + n2)


def series_min(values: Column) -> Column:
    return F.array_min(values)


def series_max(values: Column) -> Column:
    return F.array_max(values)


def series_newest(values: Column) -> Column:
    """The last value that is present; NULL if none is."""
    return F.try_element_at(F.array_compact(values), F.lit(-1))


def series_is_offline(values: Column, mode: str = "oldest") -> Column:
    """Whether two neighbouring slots at one end hold no data.

    ``oldest`` looks at the first two slots, which is the established output of
    the reports; ``latest`` looks at the last two. Shorter series are never offline.
    """
    if mode not in ("oldest", "latest"):
        raise ValueError(f"unknown mode {mode!r}")
    ends = (1, 2) if mode == "oldest" else (-1, -2)
    empty = [F.try_element_at(values, F.lit(i)).isNull() for i in ends]
    return F.when(values.isNotNull(), (F.size(values) >= 2) & empty[0] & empty[1])


def series_text(values: Column, digits: int = 6) -> Column:
    """Slots as one line of text, ``-`` for an empty slot."""
    return F.concat_ws(
        ",",
        F.transform(values, lambda v: F.coalesce(v.cast(f"decimal(24,{digits})").cast("string"), F.lit("-"))),
    )


def location_key(x: Column, y: Column, unit: Column) -> Column:
    return F.concat_ws("_", x.cast("string"), y.cast("string"), unit)


def latest_key(clock: Column, id_: Column) -> Column:
    """One number that orders rows by time and then by id.

    ``max_by`` over a struct would force sort-based aggregation; a decimal keeps
    the aggregation hash-based with map-side combine.
    """
    micros = F.unix_micros(clock.cast("timestamp")).cast("decimal(19,0)")
    shift = F.lit("10000000000000000000").cast("decimal(20,0)")
    return (micros * shift).cast("decimal(38,0)") + id_.cast("decimal(19,0)")
