"""Measurement tables: posting rules, line files, and the legacy mappable view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelhour.functions import guards
from pixelhour.functions.staging import staged
from pixelhour.sources import payloads

MEASUREMENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("payload", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("device_urn", T.StringType()),
])

DEVICE_KEYS = ("device_id", "device")


def judge_posts(posts: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``device_id``, ``device_urn`` and ``reject_reason`` (NULL when accepted) to raw posts.

    Works on batch and streaming input. Reasons: ``malformed`` (not a JSON
    object), ``bad_type`` (``device_id`` or ``device`` present but no integer),
    ``missing_device`` (neither given).
    """
    parsed = payloads.with_fields(posts, payload, strict=True)
    texts = {k: F.nullif(F.trim(F.col("fields")[k]), F.lit("")) for k in DEVICE_KEYS}
    numbers = {k: guards.to_integer(text) for k, text in texts.items()}
    bad_type = F.lit(False)
    for k in DEVICE_KEYS:
        bad_type = bad_type | (texts[k].isNotNull() & numbers[k].isNull())
    device = F.coalesce(*[numbers[k] for k in DEVICE_KEYS])
    reason = (
        F.when(F.col("fields").isNull(), "malformed")
        .when(bad_type, "bad_type")
        .when(device.isNull(), "missing_device")
    )
    judged = staged(parsed, {
        "device_id": device, "device_urn": F.col("fields")["device_urn"], "reject_reason": reason,
    })
    return judged.drop("fields")


def accept_posts(posts: DataFrame, payload: str = "payload") -> DataFrame:
    return judge_posts(posts, payload).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_posts(posts: DataFrame, payload: str = "payload") -> DataFrame:
    return judge_posts(posts, payload).filter(F.col("reject_reason").isNotNull())


def serialize_measurements(measurements: DataFrame) -> DataFrame:
    """The columns shown to API readers."""
    return measurements.select("id", "device_id", "payload")


def publish_envelopes(accepted: DataFrame, payload: str = "payload", version: int = 1) -> DataFrame:
    """One ``{"version":…,"payload":{…}}`` line per accepted post, in a column ``value``.

    The payload text goes into the envelope as it is, so numbers keep their
    spelling. Write with any text-shaped sink (files, Kafka).
    """
    return accepted.select(
        F.concat(F.lit(f'{{"version":{version},"payload":'), F.trim(F.col(payload)), F.lit("}")).alias("value")
    )


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines file as posts; see :func:`mark_as_test`."""
    return mark_as_test(spark.read.text(path), "value")


def mark_as_test(lines: DataFrame, text: str = "value") -> DataFrame:
    """Payloads with ``dev_test`` forced to true. A line that is no JSON object fails the load.

    The field is appended to the payload text, so all other values keep their
    spelling; a ``dev_test`` given earlier loses because the last equal key wins.
    """
    line = F.col(text)
    fields = payloads.parse_strict(line)
    checked = F.when(fields.isNull(), F.raise_error(F.concat(F.lit("not a JSON object: "), line)).cast("string"))
    body = F.regexp_replace(line, r"\}\s*$", "")
    empty = F.size(F.map_keys(fields)) == 0
    marked = F.concat(body, F.when(empty, "").otherwise(","), F.lit('"dev_test":true}'))
    return lines.select(checked.otherwise(marked).alias("payload"))


def mappable_view(measurements: DataFrame) -> DataFrame:
    """The legacy-dialect view: rows with latitude, longitude and captured_at.

    ``captured_at`` honours its zone and is shown as UTC wall clock; ``location``
    is (latitude, longitude) in that order. Text that does not convert gives NULL.
    """
    parsed = payloads.with_fields(measurements)
    f = F.col("fields")
    captured = F.regexp_replace(F.trim(f["captured_at"]), " (?=[+-]|Z$)", "").try_cast("timestamp")
    return (
        parsed.filter(f["latitude"].isNotNull() & f["longitude"].isNotNull() & f["captured_at"].isNotNull())
        .select(
            "id", "created_at", "updated_at", "device_id",
            captured.cast("timestamp_ntz").alias("captured_at"),
            F.struct(
                guards.to_float(f["latitude"]).alias("x"), guards.to_float(f["longitude"]).alias("y")
            ).alias("location"),
            "payload",
        )
    )
