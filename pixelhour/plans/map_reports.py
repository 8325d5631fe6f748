"""Map reports: per place its devices and, per unit, fixed-slot time series."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelhour.functions import packing, scalars, units
from pixelhour.operators import bins, shaping, snapping
from pixelhour.operators.readings import clock_literal
from pixelhour.session import written
from pixelhour.streaming import bin_state

# Slot lengths in seconds.
DAY_SECONDS = 86400
HOUR_SECONDS = 3600


def reference_hour(now: datetime) -> int:
    """The hour nearest to a moment; a tie goes to the even hour."""
    return round((now - datetime(1970, 1, 1)).total_seconds() / HOUR_SECONDS)


def _seconds_text(seconds: int) -> Column:
    return scalars.iso_text(F.timestamp_seconds(F.lit(seconds)).cast("timestamp_ntz"))


def _summary(values: Column, offline_mode: str) -> list[Column]:
    return [
        values.alias("values"),
        scalars.series_min(values).alias("min"),
        scalars.series_max(values).alias("max"),
        scalars.series_newest(values).alias("value_newest"),
        scalars.series_is_offline(values, offline_mode).alias("is_offline"),
    ]


def _span(start: Column, end: Column, first: int, last: int, seconds: int) -> list[Column]:
    return [
        start.alias("start_date"), end.alias("end_date"),
        F.lit(first).cast("long").alias("start_epoch_timepart"), F.lit(last).cast("long").alias("end_epoch_timepart"),
        F.lit(seconds).alias("ss_per_epoch_timepart"),
    ]


def _per_place(rows: DataFrame, entry: list[Column], devices: DataFrame) -> DataFrame:
    """Nest unit rows under their place and attach the device list.

    A place has at most one entry per map unit, so the list is bounded by the
    unit catalogue however busy the place is.
    """
    data = F.sort_array(F.collect_list(F.struct(units.ordinal_of(F.col("u")).alias("ordinal"), F.struct(*entry).alias("d"))))
    places = rows.groupBy("x", "y").agg(F.transform(data, lambda e: e["d"]).alias("data"))
    joined = places.join(devices, ["x", "y"], "left")
    return joined.select(
        packing.py_to_lat(F.col("y")).alias("lat"), packing.px_to_lon(F.col("x")).alias("lon"), "device_ids", "data"
    )


def windowed_bins(hourly: DataFrame, hour: int, date_filter: bool = True, test_filter: bool = True) -> DataFrame:
    """Hour bins of the last 24 hours in display units."""
    return bins.in_display_units(bins.only_still(bins.last_24_hours(hourly, hour, date_filter), test_filter))


def windowed_days(daily: DataFrame, hour: int, date_filter: bool = True, test_filter: bool = True) -> DataFrame:
    return bins.in_display_units(bins.only_still(bins.last_30_days(daily, hour, date_filter), test_filter))


def _device_pairs(pairs: DataFrame, hour: int, date_filter: bool, test_filter: bool) -> DataFrame:
    """xyt/device pairs behind the windowed bins.

    A reading's bin is in the window exactly if its own key is, so the same
    filter replaces the join with the bins.
    """
    inside = bins.only_still(bins.last_24_hours(pairs, hour, date_filter), test_filter)
    return inside.select("xyt", "device_id")


def map_24h(hourly: DataFrame, daily: DataFrame, pairs: DataFrame, now: datetime, date_filter: bool = True,
            test_filter: bool = True, radius: int = 0, offline_mode: str = "oldest") -> DataFrame:
    """One row per place: lat, lon, device_ids, data[unit, parts, category, time_series[day, hour]].

    ``hourly`` and ``daily`` are the bin states, ``pairs`` holds xyt and device_id
    of accepted readings. ``radius`` 0 keeps places where they are.
    """
    hour = reference_hour(now)
    hours = windowed_bins(hourly, hour, date_filter, test_filter)
    days = windowed_days(daily, hour, date_filter, test_filter)
    pairs = _device_pairs(pairs, hour, date_filter, test_filter)
    if radius > 0:
        # Day bins of a place without hours in view count for the place they lie near.
        day_places = days.select(packing.decode_x(F.col("xyt")).alias("x"), packing.decode_y(F.col("xyt")).alias("y"))
        moves = snapping.targets(bins.density(hours), radius, day_places.distinct())
        hours = bins.regroup(snapping.snap_bins(hours, moves))
        days = bins.regroup(snapping.snap_bins(days, moves))
        pairs = snapping.snap_bins(pairs.distinct(), moves)
    hour_series = shaping.series(hours, hour, shaping.HOUR_SLOTS, "vs", not test_filter)
    day_series = shaping.series(days, hour // 24, shaping.DAY_SLOTS, "vs_dd", not test_filter)
    # Series without hours in view fall away with the left join, which subsumes
    # purging day bins of places out of view.
    rows = hour_series.join(day_series, ["x", "y", "u"], "left")
    end = scalars.iso_text(clock_literal(now))
    day_first = hour // 24 - 29
    time_series = F.array(
        F.struct(*_span(_seconds_text(day_first * DAY_SECONDS), end, day_first, hour // 24, DAY_SECONDS),
                 *_summary(F.col("vs_dd"), offline_mode)),
        F.struct(*_span(_seconds_text((hour - 23) * HOUR_SECONDS), end, hour - 23, hour, HOUR_SECONDS),
                 *_summary(F.col("vs"), offline_mode)),
    )
    entry = [
        F.col("u").alias("unit"), units.parts_of(F.col("u")).alias("ui_display_unit_parts"),
        units.category_of(F.col("u")).alias("ui_display_category_id"), time_series.alias("time_series"),
    ]
    return _per_place(rows, entry, bins.devices_of_places(pairs))


def report_inputs(readings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hour bins, day bins and key/device pairs from one pass over the readings.

    The pass ends in a written table of device bins, which is small next to the
    readings; all three inputs read that, so no payload is parsed twice.
    """
    kept = written(bins.device_bins(readings), "device-bins")
    hourly = bins.regroup(kept)
    return hourly, bins.daily_rollup(hourly), kept.select("xyt", "device_id")


def inputs_24h(readings: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`report_inputs` of what the standard report looks at, so that no older bin is written.

    Its 30 days begin before its 24 hours; devices are kept apart in those hours only.
    """
    hour, t = reference_hour(now), packing.decode_t(F.col("xyt"))
    inside = readings.filter(t >= (hour // 24 - 29) * bins.HOURS_PER_DAY)
    seen = F.when(t > hour - bins.HOURS_PER_DAY, F.col("device_id"))
    hourly, daily, pairs = report_inputs(inside.withColumn("device_id", seen))
    return hourly, daily, pairs.filter(F.col("device_id").isNotNull())


def inputs_of_days(readings: DataFrame, moment: datetime, days: int = 1) -> tuple[DataFrame, DataFrame]:
    """Hour bins and pairs of the calendar day of ``moment`` and the days before it, ``days`` in all."""
    first = (reference_hour(moment) // 24 - days + 1) * bins.HOURS_PER_DAY
    t = packing.decode_t(F.col("xyt"))
    hourly, _, pairs = report_inputs(readings.filter(t.between(first, first + days * bins.HOURS_PER_DAY - 1)))
    return hourly, pairs


def map_two_days(readings: DataFrame, now: datetime, **options) -> list[tuple[date, DataFrame]]:
    """The daily reports of yesterday and today, with their dates: one pass over the readings for both.

    Write each with ``writers.write_daily_report``. ``options`` are those of :func:`map_daily`.
    """
    hourly, pairs = inputs_of_days(readings, now, 2)
    moments = [now - timedelta(days=1), now]
    dates = [date(1970, 1, 1) + timedelta(days=reference_hour(m) // 24) for m in moments]
    return [(d, map_daily(hourly, pairs, m, **options)) for d, m in zip(dates, moments, strict=True)]


def map_24h_from_state(spark: SparkSession, root: str, now: datetime, test_filter: bool = True) -> DataFrame:
    """The standard report over streamed state, reading the partitions of its windows, which have no upper end."""
    hour = reference_hour(now)
    hour_days, day_days = (hour - 23) // 24, hour // 24 - 29
    return map_24h(
        bin_state.read(spark, root, bin_state.HOUR, hour_days), bin_state.read(spark, root, bin_state.DAY, day_days),
        bin_state.read_pairs(spark, root, hour_days), now, True, test_filter,
    )


def map_daily_from_state(spark: SparkSession, root: str, moment: datetime, test_filter: bool = True,
                         anchor: str = "reference") -> DataFrame:
    """The report of one calendar day over streamed state, reading that day's partition."""
    day = reference_hour(moment) // 24
    days = range(day, day + 1)
    return map_daily(
        bin_state.read(spark, root, bin_state.HOUR, days), bin_state.read_pairs(spark, root, days), moment, test_filter, anchor
    )


def map_daily(hourly: DataFrame, pairs: DataFrame, moment: datetime, test_filter: bool = True,
              anchor: str = "reference", radius: int = 0) -> DataFrame:
    """One row per place for the calendar day of ``moment``: 24 slots, no category.

    With ``anchor='reference'`` (established output) slots count from the
    moment's own hour, with ``'start'`` from the day's first hour. The end date
    is one second before the last hour begins. ``radius`` is that of :func:`map_24h`.
    """
    if anchor not in ("reference", "start"):
        raise ValueError(f"unknown anchor {anchor!r}")
    hour = reference_hour(moment)
    first = hour // 24 * 24
    last = first + 23
    hours = bins.in_display_units(bins.only_still(bins.calendar_day(hourly, hour), test_filter))
    pairs = bins.only_still(bins.calendar_day(pairs, hour), test_filter).select("xyt", "device_id")
    if radius > 0:
        moves = snapping.targets(bins.density(hours), radius)
        hours = bins.regroup(snapping.snap_bins(hours, moves))
        pairs = snapping.snap_bins(pairs.distinct(), moves)
    rows = shaping.series(hours, hour if anchor == "reference" else first, shaping.DATE_SLOTS, "vs", not test_filter)
    span = _span(
        _seconds_text(first * HOUR_SECONDS), _seconds_text(last * HOUR_SECONDS - 1), first, last, HOUR_SECONDS
    )
    time_series = F.array(F.struct(*span, *_summary(F.col("vs"), "oldest")[:3]))
    entry = [
        F.col("u").alias("unit"), units.parts_of(F.col("u")).alias("ui_display_unit_parts"),
        time_series.alias("time_series"),
    ]
    return _per_place(rows, entry, bins.devices_of_places(pairs))


def flat(report: DataFrame) -> DataFrame:
    """A map report as one row per place, unit and series, with lists as text."""
    has_category = "ui_display_category_id" in report.select(F.explode("data").alias("d")).select("d.*").columns
    opened = report.select("lat", "lon", "device_ids", F.explode("data").alias("d"))
    opened = opened.select("lat", "lon", "device_ids", "d", F.explode("d.time_series").alias("s"))
    fields = opened.select("s.*").columns
    numbers = [c for c in ("min", "max", "value_newest") if c in fields]
    return opened.select(
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        F.concat_ws(",", F.col("device_ids").cast("array<string>")).alias("device_ids"),
        F.col("d.unit").alias("unit"), F.col("d.ui_display_unit_parts.si").alias("si"),
        F.col("d.ui_display_unit_parts.model").alias("model"),
        *([F.col("d.ui_display_category_id").alias("category")] if has_category else []),
        "s.start_date", "s.end_date", "s.start_epoch_timepart", "s.end_epoch_timepart", "s.ss_per_epoch_timepart",
        scalars.series_text(F.col("s.values")).alias("series"),
        *[F.round(F.col(f"s.{c}"), 6).alias(f"v_{c}") for c in numbers],
        *([F.col("s.is_offline").alias("is_offline")] if "is_offline" in fields else []),
    )
