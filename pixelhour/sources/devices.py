"""The device table: listing and lookup in the published shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEVICES = T.StructType([
    T.StructField("numeric_id", T.LongType()),
    T.StructField("location", T.StructType([
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
    ])),
    T.StructField("location_name", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("id", T.StringType()),
])


def list_devices(devices: DataFrame) -> DataFrame:
    return devices.select("id", "location", "location_name", "payload", "created_at", "updated_at")


def find_device(devices: DataFrame, id_: str | Column) -> DataFrame:
    """The device with this id; empty when there is none. The filter reaches the scan."""
    return list_devices(devices.filter(F.col("id") == id_))
