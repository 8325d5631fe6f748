"""Fixed-slot time series from bins, and pivots with data-driven columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.functions import packing

HOUR_SLOTS = range(-23, 1)
DAY_SLOTS = range(-29, 1)
DATE_SLOTS = range(0, 24)


def series(bins: DataFrame, anchor: int, slots: range, into: str = "vs", both_modes: bool = True) -> DataFrame:
    """x, y, u and an array with one element per slot of ``t - anchor``.

    Bins outside the slots still produce their row. Where a still and a moving
    bin share a slot, the moving one is shown; ``both_modes=False`` says the
    input holds still bins only and saves half the aggregation buffer.

    Each slot is a conditional maximum over at most one bin per mode: constant
    memory per group however long a place's history is, and map-side combined.
    """
    xyt = F.col("xyt")
    keyed = bins.select(
        packing.decode_x(xyt).alias("x"), packing.decode_y(xyt).alias("y"), packing.decode_m(xyt).alias("m"),
        "u", (packing.decode_t(xyt) - anchor).alias("slot"), "v",
    )
    aggregates = []
    for i, s in enumerate(slots):
        here = F.col("slot") == s
        if both_modes:
            aggregates.append(F.max(F.when(here & (F.col("m") == 1), F.col("v"))).alias(f"m{i}"))
            aggregates.append(F.max(F.when(here & (F.col("m") == 0), F.col("v"))).alias(f"s{i}"))
        else:
            aggregates.append(F.max(F.when(here, F.col("v"))).alias(f"s{i}"))
    grouped = keyed.groupBy("x", "y", "u").agg(*aggregates)
    values = [
        F.coalesce(f"m{i}", f"s{i}") if both_modes else F.col(f"s{i}") for i in range(len(slots))
    ]
    return grouped.select("x", "y", "u", F.array(*values).alias(into))


def pivot(rows: DataFrame, row_name: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Rows to one column for each of the names the caller gives; see :func:`pivot_to_map` where the data names them."""
    return rows.groupBy(row_name).pivot(column, names).agg(F.max(value))


def pivot_to_map(rows: DataFrame, row_name: str, column: str, value: str) -> DataFrame:
    """Rows to a map from column name to value: any number of names, and none of them on the driver."""
    cells = rows.filter(F.col(column).isNotNull()).groupBy(row_name, column).agg(F.max(value).alias(value))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, value))))
    return cells.groupBy(row_name).agg(entries.alias("cells"))
