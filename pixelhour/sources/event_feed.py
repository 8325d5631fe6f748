"""The generic ``events`` table seen as sensor traffic.

Each function is a row-wise projection of the whole table (no row is dropped),
so that every job has defined input with known defects: see FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelhour.functions.staging import staged

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The table is a single small file; dealt out here, because the payloads made of it stand for a parallel source."""
    return spark.read.parquet(f"{folder}/events.parquet").repartition(spark.sparkContext.defaultParallelism)


SENSOR_PAYLOAD = f"""
  concat('{{"device":', cast(user_id as string),
    case when event_id % 50 = 6 then '' else concat(',"loc_lat":',
      case when event_id % 50 = 3 then '95.5' when event_id % 50 = 7 then '0.5' when event_id % 50 = 8 then '"n/a"'
           else cast(cast(((user_id % 7) * 20 - 55) + 0.125 as decimal(9,3)) as string) end) end,
    ',"loc_lon":', case when event_id % 50 = 7 then '-0.5'
           else cast(cast(((user_id % 7) * 50 - 150) + 0.25 as decimal(9,3)) as string) end,
    case when event_id % 50 = 4 then ',"when_captured":null'
         when event_id % 50 = 5 then ',"when_captured":"1998-19-250T04:35:59Z"'
         when event_id % 50 = 9 then ''
         else concat(',"when_captured":"', date_format(ts, "{ISO_Z}"), '"') end,
    case when event_id % 50 = 0 then ',"dev_test":true' when event_id % 50 = 10 then ',"dev_test":false'
         when event_id % 50 = 11 then ',"dev_test":null' when event_id % 50 = 1 then ',"loc_motion":false' else '' end,
    case when event_id % 10 = 2 then concat(',"dev_label":"unit-', cast(user_id as string), '-',
         cast(event_id % 3 as string), '"') else '' end,
    ',"', case event_type when 'click' then 'lnd_7318u' when 'view' then 'lnd_7128ec' when 'error' then 'opc_pm02_5'
          when 'purchase' then 'env_temp' else 'bat_voltage' end, '":',
    case when event_id % 50 = 2 then '"abc"' when event_id % 50 = 12 then '-1'
         else cast(cast(value as decimal(18,2)) as string) end,
    '}}')
"""

# Bodies as clients post them: both device spellings, wrong types, no device, broken JSON.
POST_BODY = """
  case event_id % 20
    when 0 then concat('{"device_id":', user_id, ',"lndp_cpm":', event_id % 97, '}')
    when 1 then concat('{"device":', user_id, ',"device_urn":"urn:unit:', user_id, '"}')
    when 2 then concat('{"device_id":"', user_id, '","device_urn":', event_id, '}')
    when 3 then '{"lora_snr":7,"lndp_cpm":25}'
    when 4 then concat('{"device_id":"unit-', user_id, '"}')
    when 5 then concat('{"device":', user_id, '.5}')
    when 6 then concat('{"device_id":null,"device":', user_id, '}')
    when 7 then concat('{"device_id":', user_id)
    when 8 then concat('[', user_id, ']')
    when 9 then concat('{"device_id":', user_id, ',"device":"x"}')
    when 10 then concat('{"device_id":', user_id, '} garbage')
    when 11 then concat("{'device_id':", user_id, '}')
    when 12 then concat('{"device_id":', user_id, ',"v":NaN}')
    when 13 then concat('{"device_id":', user_id, '}{"device_id":', user_id + 1, '}')
    else concat('{"device_id":', user_id, ',"device":', user_id + 1, ',"lndc_cpm":', cast(value as decimal(18,2)), '}')
  end
"""

# The older payload dialect.
LEGACY_PAYLOAD = f"""
  concat('{{"device_id":', user_id,
    case when event_id % 11 = 3 then '' when event_id % 11 = 4 then ',"latitude":null'
         else concat(',"latitude":', cast(cast((user_id % 170) - 85 + 0.5 as decimal(9,3)) as string)) end,
    case when event_id % 13 = 5 then '' else concat(',"longitude":"',
         cast(cast((user_id % 360) - 180 + 0.25 as decimal(9,3)) as string), '"') end,
    case when event_id % 17 = 6 then '' else concat(',"captured_at":"',
         case when event_id % 2 = 0 then date_format(ts, "{ISO_Z}")
              else concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+09:00') end, '"') end,
    ',"lndp_cpm":', event_id % 300, '}}')
"""

# Payloads as the service forwards them, with conflicting device names.
SERVICE_PAYLOAD = f"""
  concat('{{"device":', user_id,
    case when event_id % 5 = 0 then '' when event_id % 7 = 0 then ',"device_urn":"urn:shared"'
         when event_id % 11 = 0 then concat(',"device_urn":"urn:unit:', user_id % 10, '"')
         else concat(',"device_urn":"urn:unit:', user_id, '"') end,
    case when event_type = 'signup' then ',"device_sn":null' when event_id % 3 = 0
         then concat(',"device_sn":"sn-', user_id % 4, '"') else concat(',"device_sn":"sn-', user_id, '"') end,
    case when event_id % 4 = 0 then '' else concat(',"when_captured":"',
         case when event_id % 25 = 1 then '1998-19-250T04:35:59Z' else date_format(ts, "{ISO_Z}") end, '"') end,
    case when event_id % 8 = 0 then '' else concat(',"service_uploaded":"',
         date_format(ts + interval 90 seconds, "{ISO_Z}"), '"') end,
    case when event_id % 6 = 0 then '' else concat(',"loc_lat":', cast((user_id % 7) * 20 - 55 as string)) end,
    ',"loc_lon":', case when event_id % 30 = 7 then '"east"' else cast((user_id % 7) * 50 - 150 as string) end,
    ',"dev_test":', case when event_id % 2 = 0 then 'true' else 'false' end,
    ',"pms_c00_30":', event_id, ',"env_temp":', cast(cast(value as decimal(18,2)) as string),
    ',"loc_name":"', case when event_id % 40 = 9 then repeat('n', 1100) else concat('place ', user_id % 7) end, '"',
    ',"x_note":"', event_type, '"}}')
"""


def _with_payload(events_: DataFrame, payload: str) -> DataFrame:
    """The payload text is built once per row, like a stored column."""
    return staged(events_, {"payload": F.expr(payload)})


def _as_measurements(events_: DataFrame, payload: str) -> DataFrame:
    return _with_payload(events_, payload).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("device_id"), "payload",
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )


def measurements(events_: DataFrame) -> DataFrame:
    return _as_measurements(events_, SENSOR_PAYLOAD)


def legacy_measurements(events_: DataFrame) -> DataFrame:
    return _as_measurements(events_, LEGACY_PAYLOAD)


def posts(events_: DataFrame) -> DataFrame:
    return _with_payload(events_, POST_BODY).select(F.col("event_id").alias("id"), "payload")


def service_payloads(events_: DataFrame) -> DataFrame:
    return _with_payload(events_, SERVICE_PAYLOAD).select(F.col("event_id").alias("id"), "ts", "payload")


def queue_messages(service: DataFrame) -> DataFrame:
    """Forwarded payloads inside the two envelopes a queue consumer receives."""
    return service.select(
        "id", "ts",
        F.to_json(F.struct(
            F.date_format("ts", ISO_Z).alias("Timestamp"),
            F.concat(F.lit('{"version":1,"payload":'), F.col("payload"), F.lit("}")).alias("Message"),
        )).alias("body"),
    )


def device_table(events_: DataFrame) -> DataFrame:
    """One device per user id, with its first and last time seen."""
    seen = events_.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    digest = F.md5(F.concat(F.lit("device-"), F.col("user_id").cast("string")))
    id_ = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return seen.select(
        F.col("user_id").alias("numeric_id"),
        F.struct(
            ((F.col("user_id") % 360) - 180 + 0.25).cast("double").alias("longitude"),
            ((F.col("user_id") % 170) - 85 + 0.5).cast("double").alias("latitude"),
        ).alias("location"),
        F.concat(F.lit("Place "), F.col("user_id") % 7).alias("location_name"),
        F.to_json(F.struct(F.col("user_id").alias("numeric_id"))).alias("payload"),
        "created_at", "updated_at",
        id_.alias("id"),
    )
