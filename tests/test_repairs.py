"""Inputs and reruns that once gave wrong or incomplete results."""

from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pixelhour.functions import guards, packing, sql, units
from pixelhour.operators import snapping
from pixelhour.plans import map_reports
from pixelhour.sinks import writers
from pixelhour.sources import measurements
from pixelhour.streaming import bin_state

NOW = datetime(2024, 1, 30, 20)
HOUR = map_reports.reference_hour(NOW)


def test_posts_are_one_json_object(spark):
    good = ['{"device_id":5}', ' {"device":6,"s":"]} x"} ']
    bad = ['{"device_id":5} garbage', "{'device_id':5}", '{"device_id":5,"v":NaN}', '{"device_id":5}{"device_id":6}',
           '{"device_id":5},{"device_id":6}', '{"device_id":5}] x', '{"device_id":5}] {}', '{"device_id":5},"b":{}', "", "5"]
    posts = spark.createDataFrame([(t,) for t in good + bad], "payload string")
    assert {r["payload"] for r in measurements.accept_posts(posts).collect()} == set(good)
    for text in bad:
        with pytest.raises(PySparkException):
            measurements.mark_as_test(spark.createDataFrame([(text,)], "value string")).collect()


def test_scalar_functions_are_strict(spark):
    sql.register(spark)
    row = spark.sql(
        "select convert_cpm_to_usvh(5.0d, null) a, get_ui_display_category(null) b, get_ui_display_unit_parts(null) c, "
        "is_value_in_range_for_unit(null, 'env_temp') d, xyt_convert_ism_to_m(null) e, is_float('1e-400') f, is_float('0e-400') g"
    ).first()
    assert row[:6] == (None, None, None, None, None, False) and row["g"] is True
    none, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    got = spark.range(1).select(
        units.to_usvh(F.lit(5.0), unit), units.category_of(unit), units.parts_of(unit), units.in_range(none, F.lit("env_temp")),
        packing.motion_bit(F.lit(None).cast("boolean")), guards.to_float(F.lit("-1e-400")),
    ).first()
    assert list(got) == [None] * 6


def months(root):
    return {p.name for p in root.glob("month=*")}


def test_reports_replace_only_themselves(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-05 00:00:00' service_uploaded, 1 v union all select timestamp_ntz'2024-02-05 00:00:00', 2")
    for month in (1, 2):
        moment = datetime(2024, month, 3)
        writers.write_monthly_report(rows, str(tmp_path / "m"), moment, moment, ["v"])
    assert months(tmp_path / "m") == {"month=2024-01-01", "month=2024-02-01"}
    day, root = date(2024, 1, 5), str(tmp_path / "d")
    writers.write_daily_report(rows, root, day)
    writers.write_daily_report(rows.limit(1), root, date(2024, 1, 6))
    writers.write_daily_report(rows.limit(0), root, day)
    assert spark.read.schema("v int, year int, month int, day int").json(root).select("day").distinct().collect() == [(6,)]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "a")
    messages = spark.createDataFrame([("x",), ("y",)], "value string")
    for rows in (messages, messages, messages.limit(0)):
        writers.write_raw_archive(rows, root, datetime(2024, 1, 30, 23, 59), 7)
    assert sorted(r["value"] for r in writers.read_raw_archive(spark, root).collect()) == ["x", "y"]


def bin_rows(spark, *rows):
    """(x, y, t, v) as still bins of one unit."""
    df = spark.createDataFrame(rows, "x long, y long, t long, v double")
    xyt = packing.encode_x(F.col("x")).bitwiseOR(packing.encode_y(F.col("y"))).bitwiseOR(F.col("t"))
    return df.select(xyt.alias("xyt"), F.lit("env_temp").alias("u"), F.col("v").alias("sum_v"), F.lit(1).cast("long").alias("n"), "v")


def test_day_bins_near_a_place_count_for_it(spark):
    hours = bin_rows(spark, (1000, 1000, HOUR, 10.0))
    days = bin_rows(spark, (1000, 1000, HOUR // 24, 10.0), (1010, 1000, HOUR // 24 - 10, 50.0), (1100, 1000, HOUR // 24 - 10, 70.0))
    pairs = hours.select("xyt", F.lit(5).cast("long").alias("device_id"))
    (row,) = map_reports.map_24h(hours, days, pairs, NOW, radius=26).collect()
    values = row["data"][0]["time_series"][0]["values"]
    assert values[-1] == 10.0 and values[-11] == 50.0 and sum(v is not None for v in values) == 2


def test_others_move_but_are_no_targets(spark):
    places = spark.createDataFrame([(0, 0, 5), (100, 0, 9)], "x long, y long, n long")
    others = spark.createDataFrame([(20, 0), (90, 0), (500, 0), (0, 0)], "x long, y long")
    got = {(r["x"], r["to_x"]) for r in snapping.targets(places, 26, others).collect()}
    assert got == {(0, 0), (100, 100), (20, 0), (90, 100)}


def test_state_report_has_no_upper_end(spark, tmp_path):
    root, ahead = str(tmp_path / "s"), HOUR + 24 * 10
    hours = bin_rows(spark, (1000, 1000, HOUR, 10.0), (2000, 2000, ahead, 20.0))
    days = bin_rows(spark, (1000, 1000, HOUR // 24, 10.0), (2000, 2000, ahead // 24, 20.0))
    pairs = hours.select("xyt", F.lit(5).cast("long").alias("device_id"))
    level = lambda df, name, day: df.select(
        F.lit(name).alias("level"), F.expr(day).cast("int").alias("epoch_day"), "xyt", *[c for c in ("u", "device_id", "sum_v", "n") if c in df.columns])
    t = packing.decode_t(F.col("xyt"))
    rows = [
        level(hours.withColumn("t", t), "hour", "t div 24"), level(days.withColumn("t", t), "day", "t"),
        level(pairs.withColumn("t", t), "pair", "t div 24"),
    ]
    bin_state.append(rows[0].unionByName(rows[1], True).unionByName(rows[2], True), root, 1)
    batch = map_reports.flat(map_reports.map_24h(hours, days, pairs, NOW))
    state = map_reports.flat(map_reports.map_24h_from_state(spark, root, NOW))
    assert sorted(map(str, state.collect())) == sorted(map(str, batch.collect())) and batch.count() == 4
