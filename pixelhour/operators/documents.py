"""Search documents: envelope unwrapping, enrichment, typed projection, yearly compaction."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelhour.functions import guards
from pixelhour.operators.readings import clock_literal
from pixelhour.sources import payloads

# Field names and types of the published document mapping.
FLOAT_FIELDS = """
bat_charge bat_current bat_voltage dev_humid dev_press dev_temp env_humid env_press env_temp
lnd_7128ec lnd_712u lnd_7318c lnd_7318u lnd_78017w lnd_usv loc_alt loc_lat loc_lon
opc_csecs opc_pm01_0 opc_pm02_5 opc_pm10_0 pms2_csecs pms2_pm01_0 pms2_pm02_5 pms2_pm10_0
pms_csecs pms_pm01_0 pms_pm02_5 pms_pm10_0 pms_std01_0
""".split()
LONG_FIELDS = """
dev_comms_failures dev_comms_resets dev_free_memory dev_motion_events dev_ntp_count dev_oneshot_seconds
dev_oneshots dev_received_bytes dev_restarts dev_transmitted_bytes dev_uptime device gateway_lora_snr
opc_c00_38 opc_c00_54 opc_c01_00 opc_c02_10 opc_c05_00 opc_c10_00
pms2_c00_30 pms2_c00_50 pms2_c01_00 pms2_c02_50 pms2_c05_00 pms2_c10_00 pms2_csamples
pms_c00_30 pms_c00_50 pms_c01_00 pms_c02_50 pms_c05_00 pms_c10_00 pms_csamples
""".split()
BOOLEAN_FIELDS = ["dev_motion", "dev_test"]
KEYWORD_FIELDS = """
dev_last_failure device_class device_sn device_urn gateway_received loc_country loc_name loc_olc loc_zone
pms2_model pms_model service_handler service_md5 service_transport
""".split()
DATE_FIELDS = ["service_uploaded", "when_captured"]
KEYWORD_LIMIT = 1024


def _ignored(fields: Column) -> Column:
    """Names of text fields too long to be indexed; the document keeps their text."""
    indexed = [*KEYWORD_FIELDS]
    other = [name for name in MAPPED_FIELDS if name not in KEYWORD_FIELDS]
    long = F.map_filter(fields, lambda k, v: (F.length(v) > KEYWORD_LIMIT) & (k.isin(indexed) | ~k.isin(other)))
    return F.array_sort(F.map_keys(long))


def _converted(name: str) -> Column:
    """Number texts follow the JVM's own spelling rules, like the mapping they serve; non-finite ones do not count."""
    text = f"texts.{name}"
    if name in FLOAT_FIELDS:
        value = F.expr(f"if(abs(try_cast({text} as float)) < float('inf'), try_cast({text} as float), null)")
    elif name in LONG_FIELDS:
        value = F.expr(f"coalesce(try_cast({text} as bigint), try_cast(try_cast({text} as double) as bigint))")
    elif name in BOOLEAN_FIELDS:
        value = F.expr(f"case when {text} = 'true' then true when {text} in ('false', '') then false end")
    elif name in DATE_FIELDS:
        value = guards.to_instant(F.col(text))
    else:
        value = F.col(text)
    return value.alias(name)


MAPPED_FIELDS = sorted(FLOAT_FIELDS + LONG_FIELDS + BOOLEAN_FIELDS + KEYWORD_FIELDS + DATE_FIELDS)


def unwrap(messages: DataFrame, body: str = "body") -> DataFrame:
    """Queue message bodies to payload text: outer JSON → ``Message`` → ``payload``."""
    rest = [c for c in messages.columns if c != body]
    inner = F.get_json_object(F.col(body), "$.Message")
    return messages.select(*rest, F.get_json_object(inner, "$.payload").alias("payload"))


def message_text(messages: DataFrame, body: str = "body", keep: Sequence[Column] = ()) -> DataFrame:
    """The ``Message`` of each body, as archived, and the columns to keep."""
    return messages.select(F.get_json_object(F.col(body), "$.Message").alias("value"), *keep)


def _given(text: Column) -> Column:
    """Present and neither null nor false; an empty text counts as given."""
    return F.when(text != "false", text)


def enrich(documents: DataFrame, now: datetime | Column) -> DataFrame:
    """Add fields, document time, location and index date to rows with a ``payload`` text column.

    ``document_time`` is when_captured, else service_uploaded, else ``now``.
    ``location`` exists only if both place keys do. ``index_date`` is the
    processing date, which names the daily dataset.
    """
    parsed = payloads.with_fields(documents, filtered=False)
    moment = clock_literal(now)
    f = F.col("fields")
    both = payloads.has_key(f, "loc_lat") & payloads.has_key(f, "loc_lon")
    return parsed.select(
        *documents.columns, "fields",
        F.coalesce(
            _given(f["when_captured"]), _given(f["service_uploaded"]), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ).alias("document_time"),
        F.when(both, F.struct(f["loc_lat"].alias("lat"), f["loc_lon"].alias("lon"))).alias("location"),
        moment.cast("date").alias("index_date"),
    )


def typed_projection(enriched: DataFrame, keep: list[str]) -> DataFrame:
    """The typed document: mapped fields, ``timestamp``, ``geo_point``, the remaining keys in ``extra`` and ``ignored_fields``.

    Text that does not fit its type gives NULL; a location whose parts are no
    valid coordinates is ignored as a whole. Dates honour their zone and may be
    epoch milliseconds. ``ignored_fields`` names the text fields that are too long
    for an index; their text is kept.
    """
    f = F.col("fields")
    lat, lon = guards.to_float(F.col("location.lat")), guards.to_float(F.col("location.lon"))
    valid = lat.between(-90, 90) & lon.between(-180, 180)
    # A second parse into a fixed struct: 82 lookups by position instead of
    # 82 searches through a map, and one that shrinks to the columns selected.
    # The map serves the leftovers.
    texts = F.from_json("payload", ", ".join(f"{name} string" for name in MAPPED_FIELDS))
    return enriched.withColumn("texts", texts).select(
        *keep,
        guards.to_instant(F.col("document_time")).alias("timestamp"),
        F.when(valid, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("geo_point"),
        *[_converted(name) for name in MAPPED_FIELDS],
        F.map_filter(f, lambda k, v: ~k.isin(MAPPED_FIELDS)).alias("extra"),
        _ignored(f).alias("ignored_fields"),
    )


def rewrite(documents: DataFrame, now: datetime, keep: list[str]) -> DataFrame:
    """Stored payload documents under the current mapping; a malformed date becomes NULL instead of failing."""
    return typed_projection(enrich(documents, now), keep)


def of_year(daily: DataFrame, year: int) -> DataFrame:
    """Rows of one year's daily datasets; the range filter prunes ``index_date`` partitions."""
    first, after = (F.lit(f"{y}-01-01").cast("date") for y in (year, year + 1))
    return daily.filter((F.col("index_date") >= first) & (F.col("index_date") < after))


def without_year(daily: DataFrame, year: int) -> DataFrame:
    """What remains after the compacted year's daily datasets are dropped."""
    first, after = (F.lit(f"{y}-01-01").cast("date") for y in (year, year + 1))
    return daily.filter((F.col("index_date") < first) | (F.col("index_date") >= after))
