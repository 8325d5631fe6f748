"""Hour bins, day bins and key/device pairs of a stream, kept by one streaming aggregation.

Every accepted reading counts for three groups: its hour bin, its day bin and its
key with its device. They are groups of the same aggregation, so a micro-batch
changes them together and writes them in one go: a report sees a reading's hour
and day or neither. The table is partitioned by level and day; a report over a
window of days opens nothing outside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelhour.functions import packing
from pixelhour.operators import bins
from pixelhour.streaming import changes

HOUR, DAY, PAIR = "hour", "day", "pair"
KEY = ["level", "epoch_day", "xyt", "u", "device_id"]
PARTITIONS = ["level", "epoch_day"]
SCHEMA = T.StructType([
    T.StructField("xyt", T.LongType()), T.StructField("u", T.StringType()), T.StructField("device_id", T.LongType()),
    T.StructField("sum_v", T.DoubleType()), T.StructField("n", T.LongType()), changes.BATCH,
    T.StructField("level", T.StringType()), T.StructField("epoch_day", T.IntegerType()),
])


def grouped(readings: DataFrame) -> DataFrame:
    """The groups of all readings: level, epoch_day, xyt, u, device_id, sum_v, n. The same plan serves a batch and a stream."""
    hour_day = bins.epoch_day(F.col("xyt"))
    no_unit, no_device = F.lit(None).cast("string"), F.lit(None).cast("long")
    groups = F.array(*[
        F.struct(F.lit(level).alias("level"), hour_day.alias("epoch_day"), xyt.alias("xyt"), u.alias("u"), device.alias("device_id"))
        for level, xyt, u, device in (
            (HOUR, F.col("xyt"), F.col("unit"), no_device),
            (DAY, packing.hour_key_to_day_key(F.col("xyt")), F.col("unit"), no_device),
            (PAIR, F.col("xyt"), no_unit, F.col("device_id")),
        )
    ])
    return readings.select("value", F.inline(groups)).groupBy(*KEY).agg(F.sum("value").alias("sum_v"), F.count(F.lit(1)).alias("n"))


def append(changed: DataFrame, root: str, batch_id: int) -> None:
    """Write a micro-batch's changed groups; writing it again changes nothing."""
    changes.append(changed, root, batch_id, *PARTITIONS)


def _level(spark: SparkSession, root: str, level: str, days: range | int | None) -> DataFrame:
    """Rows of a level; only the folders of the level, and of a range of days, are listed."""
    chosen = f"/epoch_day={{{','.join(map(str, days))}}}" if isinstance(days, range) else ""
    rows = changes.read(spark, root, SCHEMA, f"/level={level}{chosen}")
    return rows.filter(F.col("epoch_day") >= days) if isinstance(days, int) else rows


def read(spark: SparkSession, root: str, level: str = HOUR, days: range | int | None = None) -> DataFrame:
    """Current bins of the given days, from a first day on, or of all: xyt, u, sum_v, n, v."""
    rows = _level(spark, root, level, days).select("xyt", "u", "sum_v", "n", "batch_id")
    return bins.with_mean(changes.newest(rows, bins.KEY))


def read_pairs(spark: SparkSession, root: str, days: range | int | None = None) -> DataFrame:
    return _level(spark, root, PAIR, days).select("xyt", "device_id").distinct()


def compact(spark: SparkSession, root: str, days: Column | None = None) -> None:
    """Keep only current values of the days that a condition on ``epoch_day`` selects (all days without one)."""
    changes.compact(spark, root, SCHEMA, KEY, PARTITIONS, F.lit(True) if days is None else days)
