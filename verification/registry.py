"""Every registered query: the library run over whole driver tables, flattened for comparison.

Fractions are rounded to six digits here, and only here, because engines add
doubles in different orders.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelhour.functions import guards, packing, scalars, sql, units
from pixelhour.operators import (
    bins, device_details, device_stats, documents, readings, shaping, snapping,
)
from pixelhour.plans import device_report, map_reports
from pixelhour.session import prepare, work_dir
from pixelhour.sinks import writers
from pixelhour.sources import devices, event_feed, measurements, payloads
from pixelhour.streaming import bin_state, device_state, jobs

NOW = datetime(2024, 1, 30, 20, 0, 0)
EARLIER_RUN = datetime(2024, 1, 30, 18, 0, 0)
DAY_MOMENT = datetime(2024, 1, 15, 13, 20, 0)
HOUR = map_reports.reference_hour(NOW)
DAY_HOUR = map_reports.reference_hour(DAY_MOMENT)


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(name, 6).alias(alias or name)


# -- shared inputs ---------------------------------------------------------

def events(spark: SparkSession, folder: str) -> DataFrame:
    return event_feed.events(prepare(spark), folder)


def raw(spark, folder) -> DataFrame:
    return event_feed.measurements(events(spark, folder))


def accepted(spark, folder) -> DataFrame:
    return readings.explode_readings(raw(spark, folder), NOW)


def hourly(spark, folder) -> DataFrame:
    return bins.hourly_bins(accepted(spark, folder))


def daily(spark, folder) -> DataFrame:
    return bins.daily_rollup(hourly(spark, folder))


def service(spark, folder) -> DataFrame:
    return event_feed.service_payloads(events(spark, folder))


def typed_documents(spark, folder) -> DataFrame:
    return documents.typed_projection(documents.enrich(service(spark, folder), NOW), ["id", "ts"])


def two_groups(spark, folder, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the lower and of the upper half of the devices: an earlier and a later load that share bins."""
    middle = events(spark, folder).agg(F.floor(F.max("user_id") / 2)).scalar()
    return rows.filter(F.col("device_id") <= middle), rows.filter(F.col("device_id") > middle)


def two_loads(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Measurements up to the middle id, and those after it: two runs that share devices."""
    rows = raw(spark, folder)
    middle = events(spark, folder).agg(F.floor(F.max("event_id") / 2)).scalar()
    return rows.filter(F.col("id") <= middle), rows.filter(F.col("id") > middle)


def show_bins(df: DataFrame, *more: str) -> DataFrame:
    return df.select("xyt", "u", r6("v"), "n", *more)


def show_series(df: DataFrame, column: str = "vs") -> DataFrame:
    return df.select("x", "y", "u", scalars.series_text(F.col(column)).alias("series"))


# -- sources ---------------------------------------------------------------

def intake_accept(spark, folder):
    judged = measurements.accept_posts(event_feed.posts(events(spark, folder)))
    return judged.select("id", "device_id", "device_urn", "payload")


def intake_reject_counts(spark, folder):
    rejected = measurements.reject_posts(event_feed.posts(events(spark, folder)))
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def publish_envelope(spark, folder):
    judged = measurements.accept_posts(event_feed.posts(events(spark, folder)))
    return measurements.publish_envelopes(judged)


def jsonl_load(spark, folder):
    lines = raw(spark, folder).select(F.col("payload").alias("value"))
    loaded = payloads.with_fields(measurements.mark_as_test(lines))
    f = F.col("fields")
    return loaded.select(
        f["device"].try_cast("bigint").alias("device_id"), f["dev_test"].alias("dev_test"),
        F.size(F.map_keys(f)).cast("bigint").alias("n_keys"),
    ).groupBy("device_id", "dev_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_keys").alias("n_keys")
    )


def measurement_projection(spark, folder):
    return measurements.serialize_measurements(raw(spark, folder))


def mappable_view(spark, folder):
    view = measurements.mappable_view(event_feed.legacy_measurements(events(spark, folder)))
    return view.select("id", "created_at", "device_id", "captured_at", r6("location.x", "x"), r6("location.y", "y"))


def _device_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id", F.col("location.longitude").alias("longitude"), F.col("location.latitude").alias("latitude"),
        "location_name", "payload", "created_at", "updated_at",
    )


def device_list(spark, folder):
    return _device_columns(devices.list_devices(event_feed.device_table(events(spark, folder))))


def device_lookup(spark, folder):
    """The device seen first, looked up by its id."""
    table = event_feed.device_table(events(spark, folder))
    wanted = table.agg(F.min_by("id", F.struct("created_at", "id"))).scalar()
    return _device_columns(devices.find_device(table, wanted))


# -- payload access and rules ----------------------------------------------

def payload_unpivot(spark, folder):
    rows = readings.unpivot_payload(raw(spark, folder))
    number = guards.to_float(F.col("value"))
    return rows.select(
        "id", "device_id", "key", F.when(number.isNull(), F.col("value")).alias("text"), F.round(number, 6).alias("number")
    )


def typecheck_counts(spark, folder):
    rows = readings.unpivot_payload(raw(spark, folder))
    v = F.col("value")
    checks = {
        "n_float": guards.is_float(v), "n_numeric": guards.is_numeric(v), "n_timestamp": guards.is_timestamp(v),
        "n_boolean": guards.is_boolean(v), "n_nan": guards.is_nan(guards.to_float(v)), "n_null": v.isNull(),
    }
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(guards.taken(c)).alias(a) for a, c in checks.items()]
    )


def reject_breakdown(spark, folder):
    return readings.reject_reasons(raw(spark, folder), NOW).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("device_id").alias("n_devices")
    )


def motion_flag_counts(spark, folder):
    marked = readings.annotate(raw(spark, folder), NOW)
    return marked.groupBy("device_id", "motion").agg(F.count(F.lit(1)).alias("n"))


def explode_readings(spark, folder):
    return accepted(spark, folder).select("original_id", "device_id", "unit", r6("value"), "xyt", "event_time")


def rekey_xyt(spark, folder):
    rows = readings.annotate(raw(spark, folder), NOW).filter(F.col("place_ok"))
    lat, lon, motion, at = (F.col(c) for c in ("lat", "lon", "motion", "event_time"))
    return rows.select(
        "id", packing.lon_to_px(lon).alias("x"), packing.lat_to_py(lat).alias("y"),
        packing.motion_bit(motion).alias("m"), packing.hour_number(at).alias("t"),
        packing.pack_place_and_clock(lat, lon, motion, at).alias("xyt"),
    )


def decode_xyt(spark, folder):
    xyt = F.col("xyt")
    x, y, t = packing.decode_x(xyt), packing.decode_y(xyt), packing.decode_t(xyt)
    return accepted(spark, folder).select("xyt").distinct().select(
        "xyt", *packing.unpacked(xyt),
        packing.clear_xy(xyt).alias("no_xy"), packing.clear_xym(xyt).alias("no_xym"), packing.clear_t(xyt).alias("no_t"),
        packing.with_xy(xyt, y, x).alias("swapped"), packing.with_t(xyt, t + 1).alias("next_hour"),
        packing.hour_key_to_day_key(xyt).alias("day_key"),
        F.round(packing.px_to_lon(x), 6).alias("lon"), F.round(packing.py_to_lat(y), 6).alias("lat"),
        scalars.iso_text(packing.hour_to_clock(t)).alias("hour_text"),
        F.round(scalars.pixel_distance(x, y, F.lit(0), F.lit(0)), 4).alias("distance"),
        scalars.location_key(x, y, F.lit("any")).alias("place"),
    )


def sql_functions(spark, folder):
    """The same decoding as :func:`decode_xyt`, written in SQL with the registered functions."""
    sql.register(prepare(spark))
    accepted(spark, folder).select("xyt").distinct().createOrReplaceTempView("keys_in_use")
    return spark.sql("""
        SELECT xyt, xyt_decode_x(xyt) AS x, xyt_decode_y(xyt) AS y, xyt_decode_m(xyt) AS m, xyt_decode_t(xyt) AS t,
          xyt_clear_xy(xyt) AS no_xy, xyt_clear_xym(xyt) AS no_xym, xyt_clear_t(xyt) AS no_t,
          xyt_update_encode_xy(xyt, xyt_decode_y(xyt), xyt_decode_x(xyt)) AS swapped,
          xyt_update_encode_t(xyt, xyt_decode_t(xyt) + 1) AS next_hour, xyt_update_convert_thh_to_tdd(xyt) AS day_key,
          round(epsg3857_px_to_lon_z13(xyt_decode_x(xyt)), 6) AS lon, round(epsg3857_py_to_lat_z13(xyt_decode_y(xyt)), 6) AS lat,
          xyt_convert_t_to_isostring(xyt_decode_t(xyt)) AS hour_text,
          round(calc_dist_pythag(xyt_decode_x(xyt), xyt_decode_y(xyt), 0, 0), 4) AS distance,
          concat_ws('_', xyt_decode_x(xyt), xyt_decode_y(xyt), 'any') AS place
        FROM keys_in_use""")


def sql_rekey(spark, folder):
    """The same keys as :func:`rekey_xyt`, written in SQL with the registered functions."""
    sql.register(prepare(spark))
    readings.annotate(raw(spark, folder), NOW).createOrReplaceTempView("annotated")
    return spark.sql("""
        SELECT id, lon_to_epsg3857_px_z13(lon) AS x, lat_to_epsg3857_py_z13(lat) AS y, xyt_convert_ism_to_m(motion) AS m,
          xyt_convert_ts_to_t(event_time) AS t, xyt_convert_lat_lon_ism_ts_to_xyt(lat, lon, motion, event_time) AS xyt
        FROM annotated WHERE place_ok""")


def unit_conversion(spark, folder):
    return accepted(spark, folder).select(
        "original_id", "unit", F.round(units.to_usvh(F.col("value"), F.col("unit")), 6).alias("converted")
    )


def units_dim(spark, folder):
    """The unit catalogue with the readings each unit has."""
    counts = device_stats.stat_readings(raw(spark, folder)).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")
    )
    # The catalogue has 35 rows.
    joined = counts.join(F.broadcast(units.catalogue(spark)), "unit", "right")
    return joined.select(
        "unit", F.col("ordinal").cast("bigint").alias("ordinal"), "map_unit", "stat_unit", "lo", "lo_included", "hi",
        "cpm_divisor", "ch", "si", "mfr", "model", "category", F.coalesce("n", F.lit(0)).alias("n"), r6("max_value"),
    )


def bad_date_cleanup(spark, folder):
    docs = payloads.with_fields(service(spark, folder)).select("id", F.col("fields")["when_captured"].alias("when_captured"))
    return readings.drop_bad_months(docs)


# -- bins ------------------------------------------------------------------

def hourly_bins(spark, folder):
    return show_bins(hourly(spark, folder))


def daily_rollup(spark, folder):
    return show_bins(daily(spark, folder))


def window_24h(spark, folder):
    return show_bins(bins.last_24_hours(hourly(spark, folder), HOUR))


def window_30d(spark, folder):
    return show_bins(bins.last_30_days(daily(spark, folder), HOUR))


def window_day(spark, folder):
    return show_bins(bins.only_still(bins.calendar_day(hourly(spark, folder), DAY_HOUR)))


def location_density(spark, folder):
    return bins.density(hourly(spark, folder))


def bin_devices(spark, folder):
    window = map_reports.windowed_bins(hourly(spark, folder), HOUR)
    return bins.devices_of_bins(accepted(spark, folder), window)


def location_devices(spark, folder):
    pairs = accepted(spark, folder).select("xyt", "device_id")
    return bins.devices_of_places(pairs).select(
        "x", "y", F.concat_ws(",", F.col("device_ids").cast("array<string>")).alias("device_ids")
    )


def daily_bins_in_view(spark, folder):
    places = bins.density(map_reports.windowed_bins(hourly(spark, folder), HOUR))
    return show_bins(bins.at_places(map_reports.windowed_days(daily(spark, folder), HOUR), places))


def _fine_places(spark, folder) -> DataFrame:
    """Places as close together as GPS jitter puts them: every event near one of 40 spots."""
    rows = events(spark, folder).select(
        (F.lit(1_000_000) + (F.col("user_id") % 40) * 31 + F.col("event_id") % 23).alias("x"),
        (F.lit(700_000) + (F.col("user_id") % 8) * 37 + F.floor(F.col("value")) % 19).cast("bigint").alias("y"),
    )
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def snap_r0(spark, folder):
    return snapping.targets(_fine_places(spark, folder), 0)


def snap_r26(spark, folder):
    return snapping.targets(_fine_places(spark, folder), 26)


def reaggregate_snapped(spark, folder):
    """Hour bins moved to the busiest place within 600000 pixels, then added up."""
    still = bins.only_still(hourly(spark, folder))
    moves = snapping.targets(bins.density(still), 600_000)
    return show_bins(bins.regroup(snapping.snap_bins(still, moves)))


def _jittered(spark, folder) -> DataFrame:
    """Accepted readings around their places, as GPS jitter puts them."""
    rows, xyt = accepted(spark, folder), F.col("xyt")
    x, y = (decode(xyt) + F.col("original_id") % most for decode, most in ((packing.decode_x, 61), (packing.decode_y, 47)))
    return rows.withColumn("xyt", packing.with_xy(xyt, x, y))


def map_24h_r26(spark, folder):
    return map_reports.flat(map_reports.map_24h(*map_reports.inputs_24h(_jittered(spark, folder), NOW), NOW, radius=26))


def map_daily_r26(spark, folder):
    hours, pairs = map_reports.inputs_of_days(_jittered(spark, folder), DAY_MOMENT)
    return map_reports.flat(map_reports.map_daily(hours, pairs, DAY_MOMENT, radius=26))


# -- merges ----------------------------------------------------------------

def _state_and_delta(spark, folder, build=bins.hourly_bins):
    first, second = two_groups(spark, folder, accepted(spark, folder))
    return build(first), build(second)


def merge_hourly(spark, folder):
    return show_bins(bins.merge(*_state_and_delta(spark, folder)))


def merge_daily(spark, folder):
    build = lambda rows: bins.daily_rollup(bins.hourly_bins(rows))
    return show_bins(bins.merge(*_state_and_delta(spark, folder, build)))


def merge_new_bins(spark, folder):
    known, new = bins.split_delta(*_state_and_delta(spark, folder))
    return show_bins(known.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True))), "is_new")


def combined_mean(spark, folder):
    state, delta = _state_and_delta(spark, folder)
    old = state.select("xyt", "u", F.col("v").alias("v1"), F.col("n").alias("n1"))
    new = delta.select("xyt", "u", F.col("v").alias("v2"), F.col("n").alias("n2"))
    mean = scalars.combined_mean(F.col("v1"), F.col("v2"), F.col("n1"), F.col("n2"))
    return old.join(new, bins.KEY).select("xyt", "u", F.round(mean, 6).alias("v"), (F.col("n1") + F.col("n2")).alias("n"))


def merge_touch(spark, folder):
    state, delta = _state_and_delta(spark, folder)
    stored = state.withColumn("updated_at", readings.clock_literal(EARLIER_RUN))
    merged = device_stats.touch_changed(stored, bins.merge(stored, delta), bins.KEY, NOW)
    return show_bins(merged, "updated_at")


def incremental_candidates(spark, folder):
    """Measurements above the highest id accepted from the first load."""
    first, _ = two_loads(spark, folder)
    mark = readings.explode_readings(first, NOW).agg(F.max("original_id")).scalar()
    return readings.after_id(raw(spark, folder), mark).select("id", "device_id", "created_at")


def incremental_gaps(spark, folder):
    """The second load, and rows of the first that were committed after its run."""
    first, _ = two_loads(spark, folder)
    return readings.not_seen(raw(spark, folder), readings.seen_ids(first.filter("id % 97 <> 5"))).select("id", "device_id", "created_at")


def incremental_by_ts(spark, folder):
    first, _ = two_loads(spark, folder)
    mark = device_stats.device_stats(first).agg(F.max("max_ts")).scalar()
    return readings.after_time(raw(spark, folder), mark).select("id", "device_id", "created_at")


def accepted_candidates(spark, folder):
    """Candidates that contributed at least one reading."""
    return accepted(spark, folder).select("original_id", "xyt", "unit").distinct()


# -- series and reports ----------------------------------------------------

def _hours(spark, folder, test_filter=True):
    return map_reports.windowed_bins(hourly(spark, folder), HOUR, True, test_filter)


def series_24h(spark, folder):
    return show_series(shaping.series(_hours(spark, folder), HOUR, shaping.HOUR_SLOTS, both_modes=False))


def series_30d(spark, folder):
    days = map_reports.windowed_days(daily(spark, folder), HOUR)
    return show_series(shaping.series(days, HOUR // 24, shaping.DAY_SLOTS, both_modes=False))


def series_day(spark, folder):
    hours = bins.in_display_units(bins.only_still(bins.calendar_day(hourly(spark, folder), DAY_HOUR)))
    return show_series(shaping.series(hours, DAY_HOUR, shaping.DATE_SLOTS, both_modes=False))


def series_devtest(spark, folder):
    return show_series(shaping.series(_hours(spark, folder, False), HOUR, shaping.HOUR_SLOTS))


def series_summary(spark, folder):
    vs = F.col("vs")
    rows = shaping.series(_hours(spark, folder), HOUR, shaping.HOUR_SLOTS, both_modes=False)
    return rows.select(
        "x", "y", "u",
        F.round(scalars.series_min(vs), 6).alias("v_min"), F.round(scalars.series_max(vs), 6).alias("v_max"),
        F.round(scalars.series_newest(vs), 6).alias("v_newest"),
        scalars.series_is_offline(vs).alias("offline_oldest"),
        scalars.series_is_offline(vs, "latest").alias("offline_latest"),
        scalars.series_text(F.reverse(vs)).alias("reversed"),
    )


def dynamic_pivot(spark, folder):
    rows = accepted(spark, folder).groupBy("device_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    return shaping.pivot(rows, "device_id", "unit", "n", ["env_temp", "lnd_7128ec", "lnd_7318u", "opc_pm02_5"])


def pivot_cells(spark, folder):
    """The pivot over all units the data has, a map for each device."""
    rows = accepted(spark, folder).groupBy("device_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    cells = F.transform(F.map_entries("cells"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return shaping.pivot_to_map(rows, "device_id", "unit", "n").select("device_id", F.array_join(F.sort_array(cells), ",").alias("cells"))


def _map(spark, folder, date_filter=True, test_filter=True, radius=0):
    rows = accepted(spark, folder)
    inputs = map_reports.inputs_24h(rows, NOW) if date_filter else map_reports.report_inputs(rows)
    return map_reports.flat(map_reports.map_24h(*inputs, NOW, date_filter, test_filter, radius))


def map_24h(spark, folder):
    return _map(spark, folder)


def map_24h_devtest(spark, folder):
    return _map(spark, folder, test_filter=False)


def map_24h_all_dates(spark, folder):
    return _map(spark, folder, date_filter=False)


def map_daily(spark, folder, anchor="reference"):
    hours, pairs = map_reports.inputs_of_days(accepted(spark, folder), DAY_MOMENT)
    return map_reports.flat(map_reports.map_daily(hours, pairs, DAY_MOMENT, anchor=anchor))


def map_two_days(spark, folder):
    """Both reports of one run, written by date and read back."""
    path = work_dir(prepare(spark), "two-days")
    for day, report in map_reports.map_two_days(accepted(spark, folder), DAY_MOMENT):
        writers.write_daily_report(report, path, day)
        schema = report.schema
    return map_reports.flat(spark.read.schema(schema).json(path))


def map_daily_from_start(spark, folder):
    return map_daily(spark, folder, "start")


# -- devices ---------------------------------------------------------------

def _show_stats(df):
    return df.select("device_id", "unit", r6("min", "v_min"), r6("max", "v_max"), r6("val", "v_val"), "n", "min_ts", "max_ts")


def device_stats_query(spark, folder):
    return _show_stats(device_stats.device_stats(raw(spark, folder)))


def merge_device_stats(spark, folder):
    first, second = two_loads(spark, folder)
    return _show_stats(device_stats.merge_device_stats(device_stats.device_stats(first), device_stats.device_stats(second)))


def device_meta(spark, folder):
    return device_stats.device_meta(raw(spark, folder), NOW)


def dev_test_cleared(spark, folder):
    """Devices that sent no test mode in a load, for both loads."""
    first, second = two_loads(spark, folder)
    cleared = [
        device_stats.cleared_test_mode(rows, device_stats.sent_metadata(rows), run).withColumn("load", F.lit(name))
        for name, rows, run in (("first", first, EARLIER_RUN), ("second", second, NOW))
    ]
    return cleared[0].union(cleared[1])


def merge_device_meta(spark, folder):
    first, second = two_loads(spark, folder)
    return device_stats.merge_device_meta(
        device_stats.device_meta(first, EARLIER_RUN), device_stats.device_meta(second, NOW)
    )


def device_stats_report(spark, folder):
    rows = raw(spark, folder)
    return device_report.flat(device_report.device_stats_report(
        device_stats.device_stats(rows), device_stats.device_meta(rows, NOW)
    ))


def top_devices(spark, folder):
    return device_details.top_devices(typed_documents(spark, folder).select("device"), 1000)


def device_details_query(spark, folder):
    return device_details.device_details(typed_documents(spark, folder).select("device", "device_sn", "device_urn"), min_documents=3)


def backfill_device_details(spark, folder):
    docs = typed_documents(spark, folder).select("id", "device", "device_sn", "device_urn")
    details = device_details.device_details(docs, min_documents=3)
    return device_details.backfill(docs, details)


# -- documents and sinks ---------------------------------------------------

def doc_enrich(spark, folder):
    messages = event_feed.queue_messages(service(spark, folder))
    rows = documents.enrich(documents.unwrap(messages), NOW)
    return rows.select(
        "id", "document_time", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"),
        F.col("index_date").cast("string").alias("index_date"),
    )


def _show_typed(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "timestamp", "when_captured", "service_uploaded", "device", "device_sn", "device_urn", "dev_test",
        "pms_c00_30", F.round(F.col("env_temp").cast("double"), 3).alias("env_temp"), "loc_name", "bat_charge",
        F.col("loc_lat").cast("double").alias("loc_lat"), F.col("loc_lon").cast("double").alias("loc_lon"),
        F.col("geo_point.lat").alias("lat"), F.col("geo_point.lon").alias("lon"),
        F.concat_ws(",", "ignored_fields").alias("ignored"), F.col("extra")["x_note"].alias("x_note"), F.size(F.map_keys("extra")).cast("bigint").alias("n_extra"),
    )


def doc_typed_projection(spark, folder):
    return _show_typed(typed_documents(spark, folder))


def doc_rewrite(spark, folder):
    """Stored documents written under the current mapping and read back."""
    path = work_dir(prepare(spark), "rewrite")
    documents.rewrite(service(spark, folder), NOW, ["id", "ts"]).write.parquet(path)
    return _show_typed(spark.read.parquet(path))


def csv_dump(spark, folder):
    table = raw(spark, folder)
    path = work_dir(spark, "dump")
    writers.write_csv_dump(table, path)
    return writers.read_csv_dump(spark, path, table.schema)


def _read_back(spark, report: DataFrame, write) -> DataFrame:
    path = work_dir(spark, "report")
    write(report, path)
    return spark.read.schema(report.schema).json(path).select(report.columns)


def map_24h_written(spark, folder):
    return _read_back(spark, map_24h(spark, folder), writers.write_report)


def map_daily_written(spark, folder):
    """Written for its date after another one, which stays."""
    day = DAY_MOMENT.date()

    def write(report, path):
        writers.write_daily_report(report.limit(0), path, EARLIER_RUN.date())
        writers.write_daily_report(report, path, day)

    return _read_back(spark, map_daily(spark, folder), write)


def device_stats_report_written(spark, folder):
    return _read_back(spark, device_stats_report(spark, folder), writers.write_report)


def monthly_report_counts(spark, folder):
    table = service(spark, folder).select(
        "id", (F.col("ts") + F.expr("interval 90 seconds") - F.expr("make_dt_interval(cast(id % 45 as int))")).alias("service_uploaded")
    )
    path = work_dir(spark, "monthly")
    writers.write_monthly_report(
        table, path, datetime(2023, 12, 15), datetime(2024, 1, 3), ["service_uploaded", "id"]
    )
    back = spark.read.schema("id bigint, service_uploaded timestamp_ntz, month date").option("header", True).csv(path)
    return back.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id")
    ).select(F.col("month").cast("string").alias("month"), "n", "min_id", "max_id")


def _daily_dataset(spark, folder) -> str:
    """Typed documents under the day they would have been processed, spread over two years."""
    path = work_dir(prepare(spark), "daily")
    spread = F.date_sub(F.col("ts").cast("date"), (F.col("device") % 60).cast("int"))
    rows = typed_documents(spark, folder).select("id", "device", "env_temp", spread.alias("index_date"))
    rows = rows.hint("rebalance", "index_date")
    writers.write_daily_documents(rows, path, 0)
    return path


def yearly_compaction_counts(spark, folder):
    source, target = _daily_dataset(spark, folder), work_dir(spark, "yearly")
    for year in (2023, 2024):
        writers.compact_year(spark, source, target, year)
    return spark.read.parquet(target).groupBy("year", "device").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id")
    )


def retention_remaining(spark, folder):
    """What is left in the folder once 2023 is compacted and its daily datasets are deleted."""
    source, target = _daily_dataset(spark, folder), work_dir(spark, "yearly")
    writers.compact_year(spark, source, target, 2023)
    writers.retire_year(spark, source, target, 2023)
    return spark.read.parquet(source).groupBy(F.col("index_date").cast("string").alias("index_date")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _archive_index(spark, path):
    # The empty text behind the last separator of a file is no message.
    return writers.read_raw_archive(spark, path).groupBy(
        F.col("date").cast("string").alias("date"), F.col("hour").cast("int").alias("hour"),
        F.col("minute").cast("int").alias("minute"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("n_chars"))


def raw_archive_index(spark, folder):
    path = work_dir(prepare(spark), "archive")
    messages = event_feed.queue_messages(service(spark, folder))
    writers.write_raw_archive(documents.message_text(messages), path, NOW, 0)
    return _archive_index(spark, path)


# -- streams ---------------------------------------------------------------

def event_stream(spark, folder) -> DataFrame:
    schema = events(spark, folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _run(start, spark, stream, purpose, **options):
    root = work_dir(spark, purpose)
    start(stream, f"{root}/out", f"{root}/checkpoint", interval=None, **options).awaitTermination()
    return f"{root}/out"


def fixed_clock() -> datetime:
    return NOW


def load_stream(spark, folder) -> DataFrame:
    """Both loads in one folder, a micro-batch each.

    A micro-batch takes as many files as the first load has, the oldest first; the second load has no more.
    Each load is written by all cores, so that a micro-batch is read by all.
    """
    path = work_dir(prepare(spark), "loads")
    first, second = two_loads(spark, folder)
    first.write.parquet(path)
    files = len(spark.read.schema(first.schema).parquet(path).inputFiles())
    second.coalesce(files).write.mode("append").parquet(path)
    return spark.readStream.schema(first.schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_hourly_state(spark, folder):
    root = _run(jobs.keep_hourly_state, spark, event_feed.measurements(event_stream(spark, folder)), "state", clock=fixed_clock)
    return show_bins(bin_state.read(spark, root))


def stream_daily_state(spark, folder):
    root = _run(jobs.keep_hourly_state, spark, event_feed.measurements(event_stream(spark, folder)), "state", clock=fixed_clock)
    bin_state.compact(spark, root, F.col("epoch_day") % 2 == 0)
    return show_bins(bin_state.read(spark, root, bin_state.DAY))


def stream_map_24h(spark, folder):
    root = _run(jobs.keep_hourly_state, spark, event_feed.measurements(event_stream(spark, folder)), "state", clock=fixed_clock)
    return map_reports.flat(map_reports.map_24h_from_state(spark, root, NOW))


def stream_map_daily(spark, folder):
    root = _run(jobs.keep_hourly_state, spark, event_feed.measurements(event_stream(spark, folder)), "state", clock=fixed_clock)
    return map_reports.flat(map_reports.map_daily_from_state(spark, root, DAY_MOMENT))


def _kept_devices(spark, folder) -> tuple[str, str]:
    loads = load_stream(spark, folder)
    return _run(jobs.keep_device_stats, spark, loads, "stats"), _run(jobs.keep_device_texts, spark, loads, "texts", clock=fixed_clock)


def stream_device_stats(spark, folder):
    return _show_stats(device_state.read_stats(spark, _run(jobs.keep_device_stats, spark, load_stream(spark, folder), "stats")))


def stream_device_texts(spark, folder):
    texts = _run(jobs.keep_device_texts, spark, load_stream(spark, folder), "texts", clock=fixed_clock)
    return device_state.read_texts(spark, texts)


def stream_device_report(spark, folder):
    return device_report.flat(device_state.report(spark, *_kept_devices(spark, folder)))


def stream_windowed_hours(spark, folder):
    """The bounded variant with a lateness no row exceeds."""
    def start(stream, root, checkpoint, interval):
        windows = jobs.windowed_hours(stream, NOW, "100 days")
        return jobs.append_changes(windows, root, checkpoint, "windowed-hours", interval)

    root = _run(start, spark, event_feed.measurements(event_stream(spark, folder)), "windows")
    return show_bins(spark.read.parquet(root))


def stream_archive(spark, folder):
    messages = event_feed.queue_messages(event_feed.service_payloads(event_stream(spark, folder)))
    return _archive_index(spark, _run(jobs.archive_messages, spark, messages, "archive", clock=fixed_clock))


def stream_documents(spark, folder):
    messages = event_feed.queue_messages(event_feed.service_payloads(event_stream(spark, folder)))
    path = _run(jobs.enrich_messages, spark, messages, "documents", clock=fixed_clock)
    return spark.read.parquet(path).groupBy(
        F.col("index_date").cast("string").alias("index_date"), "device"
    ).agg(F.count(F.lit(1)).alias("n"), F.count("when_captured").alias("n_dated"), F.count("geo_point").alias("n_placed"))


QUERIES = {
    "intake_accept": intake_accept, "intake_reject_counts": intake_reject_counts,
    "publish_envelope": publish_envelope, "jsonl_load": jsonl_load,
    "measurement_projection": measurement_projection, "mappable_view": mappable_view,
    "device_list": device_list, "device_lookup": device_lookup,
    "payload_unpivot": payload_unpivot, "typecheck_counts": typecheck_counts,
    "reject_breakdown": reject_breakdown, "motion_flag_counts": motion_flag_counts,
    "explode_readings": explode_readings, "rekey_xyt": rekey_xyt, "decode_xyt": decode_xyt,
    "sql_functions": sql_functions, "sql_rekey": sql_rekey,
    "unit_conversion": unit_conversion, "units_dim": units_dim, "bad_date_cleanup": bad_date_cleanup,
    "hourly_bins": hourly_bins, "daily_rollup": daily_rollup,
    "window_24h": window_24h, "window_30d": window_30d, "window_day": window_day,
    "location_density": location_density, "bin_devices": bin_devices, "location_devices": location_devices,
    "daily_bins_in_view": daily_bins_in_view, "snap_r0": snap_r0, "snap_r26": snap_r26,
    "reaggregate_snapped": reaggregate_snapped,
    "merge_hourly": merge_hourly, "merge_daily": merge_daily, "merge_new_bins": merge_new_bins,
    "combined_mean": combined_mean, "merge_touch": merge_touch,
    "incremental_gaps": incremental_gaps,
    "incremental_candidates": incremental_candidates, "incremental_by_ts": incremental_by_ts,
    "accepted_candidates": accepted_candidates,
    "series_24h": series_24h, "series_30d": series_30d, "series_day": series_day,
    "series_devtest": series_devtest, "series_summary": series_summary, "map_24h_written": map_24h_written, "map_daily_written": map_daily_written,
    "device_stats_report_written": device_stats_report_written,
    "dynamic_pivot": dynamic_pivot, "pivot_cells": pivot_cells, "map_two_days": map_two_days,
    "map_24h": map_24h, "map_24h_devtest": map_24h_devtest, "map_24h_all_dates": map_24h_all_dates,
    "map_24h_r26": map_24h_r26, "map_daily_r26": map_daily_r26,
    "map_daily": map_daily, "map_daily_from_start": map_daily_from_start,
    "device_stats": device_stats_query, "merge_device_stats": merge_device_stats,
    "device_meta": device_meta, "dev_test_cleared": dev_test_cleared, "merge_device_meta": merge_device_meta,
    "device_stats_report": device_stats_report,
    "top_devices": top_devices, "device_details": device_details_query,
    "backfill_device_details": backfill_device_details,
    "doc_enrich": doc_enrich, "doc_typed_projection": doc_typed_projection, "doc_rewrite": doc_rewrite,
    "csv_dump": csv_dump, "monthly_report_counts": monthly_report_counts,
    "yearly_compaction_counts": yearly_compaction_counts, "retention_remaining": retention_remaining,
    "raw_archive_index": raw_archive_index,
    "stream_hourly_state": stream_hourly_state, "stream_daily_state": stream_daily_state,
    "stream_map_24h": stream_map_24h, "stream_device_stats": stream_device_stats, "stream_device_texts": stream_device_texts,
    "stream_device_report": stream_device_report, "stream_windowed_hours": stream_windowed_hours,
    "stream_map_daily": stream_map_daily, "stream_archive": stream_archive, "stream_documents": stream_documents,
}
