"""Measurements to typed readings: validity rules, unpivot, packed key."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelhour.functions import guards, packing, units
from pixelhour.functions.staging import staged
from pixelhour.sources import payloads

# The validity limits.
LAT_LIMIT = 85.05
LON_LIMIT = 180.0
NULL_ISLAND = 1.0
EARLIEST = "2011-03-11 00:00:00"
FUTURE_ALLOWANCE = timedelta(hours=48)
TIME_KEYS = ("when_captured", "gateway_received")


def clock_literal(moment: datetime | Column) -> Column:
    """A moment as a column; a column is taken as it is, so a stream can pass its batch time."""
    return moment if isinstance(moment, Column) else F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def place_is_valid(lat: Column, lon: Column) -> Column:
    """Inside the map and not in the square around (0, 0). NULL and NaN fail."""
    on_map = lat.between(-LAT_LIMIT, LAT_LIMIT) & lon.between(-LON_LIMIT, LON_LIMIT)
    off_island = ~lat.between(-NULL_ISLAND, NULL_ISLAND) | ~lon.between(-NULL_ISLAND, NULL_ISLAND)
    return guards.taken(on_map & off_island)


def time_is_valid(present: Column, clock: Column, now: datetime | Column) -> Column:
    """An absent key passes; a present one must parse and lie in range, so JSON null fails."""
    in_range = clock.between(F.lit(EARLIEST).cast("timestamp_ntz"), clock_literal(now) + F.lit(FUTURE_ALLOWANCE))
    return ~present | guards.taken(in_range)


def motion_flag(fields: Column) -> Column:
    """Moving or under test. ``loc_motion`` counts by presence, ``dev_test`` by value; an unreadable value counts."""
    return (
        F.when(payloads.has_key(fields, "loc_motion"), True)
        .when(payloads.has_key(fields, "dev_test"), F.coalesce(guards.to_boolean(fields["dev_test"]), F.lit(True)))
        .otherwise(False)
    )


def annotate(measurements: DataFrame, now: datetime | Column) -> DataFrame:
    """One row per measurement with parsed place, time, flags and validity verdicts."""
    f = F.col("fields")
    typed = staged(payloads.with_fields(measurements), {
        "lat": guards.to_float(f["loc_lat"]),
        "lon": guards.to_float(f["loc_lon"]),
        "motion": motion_flag(f),
        **{f"{k}_clock": guards.to_wall_clock(f[k]) for k in TIME_KEYS},
        **{f"has_{k}": guards.taken(payloads.has_key(f, k)) for k in TIME_KEYS},
    })
    return typed.select(
        *measurements.columns, "fields", "lat", "lon", "motion",
        F.coalesce(*[F.col(f"{k}_clock") for k in TIME_KEYS], F.col("created_at")).alias("event_time"),
        place_is_valid(F.col("lat"), F.col("lon")).alias("place_ok"),
        *[
            time_is_valid(F.col(f"has_{k}"), F.col(f"{k}_clock"), now).alias(f"{k}_ok")
            for k in TIME_KEYS
        ],
    )


def explode_readings(measurements: DataFrame, now: datetime | Column) -> DataFrame:
    """Accepted map readings: original_id, device_id, unit, value, xyt, event_time, created_at, updated_at.

    Rows without a place are skipped on the raw text before parsing, only map
    units are unpivoted, and the validity verdict decides inside the generator
    whether a row fans out at all. The key is computed per measurement and comes
    out of the generator, so later filters on it stay cheap comparisons.
    """
    candidates = measurements.filter(
        payloads.may_contain_key(F.col("payload"), "loc_lat")
        & payloads.may_contain_key(F.col("payload"), "loc_lon")
    )
    marked = annotate(candidates, now)
    valid = F.col("place_ok")
    for k in TIME_KEYS:
        valid = valid & F.col(f"{k}_ok")
    key = packing.pack_place_and_clock(F.col("lat"), F.col("lon"), F.col("motion"), F.col("event_time"))
    keyed = marked.withColumn("xyt", F.when(valid, key))
    wanted = F.filter(F.map_entries("fields"), lambda e: units.is_map_unit(e["key"]))
    rows = F.transform(
        wanted,
        lambda e: F.struct(
            e["key"].alias("unit"), guards.to_float(e["value"]).alias("value"), F.col("xyt").alias("xyt")
        ),
    )
    exploded = keyed.select(
        F.col("id").alias("original_id"), "device_id", "event_time", "created_at", "updated_at",
        F.inline(F.when(F.col("xyt").isNotNull(), rows)),
    )
    return exploded.filter(F.col("value").isNotNull() & units.in_range(F.col("value"), F.col("unit"))).select(
        "original_id", "device_id", "unit", "value", "xyt", "event_time", "created_at", "updated_at"
    )


def unpivot_payload(measurements: DataFrame) -> DataFrame:
    """Every key of every payload: id, device_id, key, value."""
    return payloads.unpivot(payloads.with_fields(measurements), ["id", "device_id"])


def reject_reasons(measurements: DataFrame, now: datetime | Column) -> DataFrame:
    """Each measurement's first failed rule (``accepted`` if none): id, device_id, reason."""
    f = F.col("fields")
    reason = (
        F.when(f.isNull(), "malformed")
        .when(~payloads.has_key(f, "loc_lat") | ~payloads.has_key(f, "loc_lon"), "no_place")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "place_not_numeric")
        .when(~F.col("place_ok"), "place_out_of_range")
        .when(~F.col("when_captured_ok"), "when_captured")
        .when(~F.col("gateway_received_ok"), "gateway_received")
    )
    entries = F.filter(F.map_entries(f), lambda e: units.is_map_unit(e["key"]))
    numeric = F.filter(entries, lambda e: guards.taken(guards.is_float(e["value"])))
    in_range = F.filter(numeric, lambda e: units.in_range(guards.to_float(e["value"]), e["key"]))
    marked = annotate(measurements, now).select(
        "id", "device_id", reason.alias("reason"),
        F.size(entries).alias("n_units"), F.size(numeric).alias("n_numeric"), F.size(in_range).alias("n_in_range"),
    )
    return marked.select(
        "id", "device_id",
        F.coalesce(
            "reason",
            F.when(F.col("n_units") == 0, "no_map_unit")
            .when(F.col("n_numeric") == 0, "value_not_numeric")
            .when(F.col("n_in_range") == 0, "value_out_of_range")
            .otherwise("accepted"),
        ).alias("reason"),
    )


def after_id(measurements: DataFrame, high_water: int | Column | None) -> DataFrame:
    """Incremental candidates by id: those above the highest id already accepted (0 before the first)."""
    mark = high_water if isinstance(high_water, Column) else F.lit(high_water)
    return measurements.filter(F.col("id") > F.coalesce(mark, F.lit(0)))


def seen_ids(ids: DataFrame) -> DataFrame:
    """The set of ids already taken, as bits: word, bits, a row for 64 neighbouring ids.

    A high-water mark loses an id that is committed late, below the mark; this set
    does not. It is built by a hash aggregation of two longs, and sets are merged
    by building one of both: a run adds the words it took.
    """
    number = F.col("id").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    return merge_seen(ids.filter(number.isNotNull()).select(F.shiftright(number, 6).alias("word"), bit.alias("bits")))


def merge_seen(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def not_seen(measurements: DataFrame, seen: DataFrame) -> DataFrame:
    """Incremental candidates by id, gaps included: the rows whose id is not in the set.

    An equality join on the ids' words, so both sides are read once and neither is
    collected. Rows without an id can never be marked and are left out.
    """
    word, number = F.shiftright(F.col("id").cast("long"), 6), F.col("id").cast("long")
    known = seen.select(F.col("word").alias("seen_word"), F.col("bits").alias("seen_bits"))
    joined = measurements.filter(F.col("id").isNotNull()).join(known, word == F.col("seen_word"), "left")
    taken = F.call_function("shiftright", F.coalesce("seen_bits", F.lit(0).cast("long")), number.bitwiseAND(F.lit(63)).cast("int"))
    return joined.filter(taken.bitwiseAND(F.lit(1)) == 0).select(*[measurements[c] for c in measurements.columns])


def after_time(measurements: DataFrame, high_water: datetime | Column | None) -> DataFrame:
    """Incremental candidates by arrival: strictly later than the last arrival counted."""
    if isinstance(high_water, datetime):
        high_water = clock_literal(high_water)
    mark = F.lit(None) if high_water is None else high_water
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return measurements.filter(F.col("created_at") > F.coalesce(mark.cast("timestamp_ntz"), start))


def drop_bad_months(documents: DataFrame) -> DataFrame:
    """Documents without an impossible month in a textual ``when_captured``."""
    return documents.filter(~has_bad_month(F.col("when_captured")))


def has_bad_month(when_captured: Column) -> Column:
    month = F.split(when_captured, "-")
    return guards.taken(guards.to_integer(F.try_element_at(month, F.lit(2))) > 12)
