"""Compute expensive columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read as plain values.

    Catalyst pushes a filter below a projection by substituting the projected
    expression, so a filter on a parsed field would parse the JSON again, once
    per mention. A generator that yields exactly one row is a place such
    substitution stops, at the price of one row copy.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
