"""Device statistics report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.functions import scalars, units


def device_stats_report(stats: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per device: dev_label, dev_test, units[unit, stats] in catalogue order.

    A device has at most one entry per statistics unit.
    """
    entry = F.struct(
        units.ordinal_of(F.col("unit")).alias("ordinal"),
        F.struct(
            F.col("unit"),
            F.struct(
                "min", "max", "val", "n",
                scalars.iso_text(F.col("min_ts")).alias("min_ts"), scalars.iso_text(F.col("max_ts")).alias("max_ts"),
            ).alias("stats"),
        ).alias("d"),
    )
    per_device = stats.groupBy("device_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["d"]).alias("units")
    )
    texts = meta.groupBy("device_id").agg(*[
        F.max(F.when(F.col("unit") == u, F.col("val"))).alias(u) for u in units.TEXT_UNITS
    ])
    return per_device.join(texts, "device_id", "left").select("device_id", "dev_label", "dev_test", "units")


def flat(report: DataFrame) -> DataFrame:
    """One row per device and unit."""
    opened = report.select("device_id", "dev_label", "dev_test", F.posexplode("units").alias("pos", "u"))
    return opened.select(
        "device_id", "dev_label", "dev_test", "pos", F.col("u.unit").alias("unit"),
        *[F.round(F.col(f"u.stats.{c}"), 6).alias(f"v_{c}") for c in ("min", "max", "val")],
        F.col("u.stats.n").alias("n"), F.col("u.stats.min_ts").alias("min_ts"), F.col("u.stats.max_ts").alias("max_ts"),
    )
