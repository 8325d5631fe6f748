"""Device statistics and device texts of a stream.

Statistics are one streaming aggregation per device and unit (extremes, count,
first and last moment, and the value of the latest measurement by arg-max).
Texts follow the rule of the batch job, where a load's latest text replaces the
kept one and a device silent about its test mode in a load is not testing, so each
micro-batch's own result is written and the newest one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pixelhour.operators import device_stats
from pixelhour.plans import device_report
from pixelhour.streaming import changes

KEY = device_stats.KEY
_KEY = [T.StructField("device_id", T.LongType()), T.StructField("unit", T.StringType())]
STATS = T.StructType([
    *_KEY, *[T.StructField(c, T.DoubleType()) for c in ("min", "max", "val")], T.StructField("n", T.LongType()),
    *[T.StructField(c, T.TimestampNTZType()) for c in ("min_ts", "max_ts")], changes.BATCH,
])
TEXTS = T.StructType([*_KEY, T.StructField("val", T.StringType()), T.StructField("ts", T.TimestampNTZType()), changes.BATCH])


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    """Current statistics: device_id, unit, min, max, val, n, min_ts, max_ts."""
    return changes.newest(changes.read(spark, root, STATS), KEY)


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """Current texts: device_id, unit, val, ts."""
    return changes.newest(changes.read(spark, root, TEXTS), KEY)


def report(spark: SparkSession, stats_root: str, texts_root: str) -> DataFrame:
    """The device report from kept state alone; no measurement is read."""
    return device_report.device_stats_report(read_stats(spark, stats_root), read_texts(spark, texts_root))
