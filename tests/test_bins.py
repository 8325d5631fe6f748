import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pixelhour.functions import packing
from pixelhour.operators import bins, device_stats, shaping, snapping
from pixelhour.plans import map_reports


def reading_rows(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [
        (rng.choice([10, 11, 2_000_000]), rng.choice([5, 6]), rng.randrange(2), 474_000 + rng.randrange(60),
         rng.choice(["lnd_7318u", "env_temp"]), rng.randrange(1, 9), round(rng.uniform(1, 90), 2))
        for _ in range(n)
    ]
    df = spark.createDataFrame(rows, "x long, y long, m long, t long, unit string, device_id long, value double")
    return df.select("unit", "device_id", "value", packing.pack(*[F.col(c) for c in "xymt"]).alias("xyt"))


def as_dict(df):
    return {(r["xyt"], r["u"]): (round(r["v"], 9), r["n"]) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_any_split_merges_to_the_whole(spark, parts):
    rows = reading_rows(spark).withColumn("part", F.abs(F.hash("value", "xyt")) % parts).persist()
    whole = as_dict(bins.hourly_bins(rows))
    state = bins.hourly_bins(rows.limit(0))
    for p in range(parts):
        state = bins.merge(state, bins.hourly_bins(rows.filter(F.col("part") == p)))
    assert as_dict(state) == whole
    assert as_dict(bins.regroup(bins.device_bins(rows))) == whole


def test_daily_mean_is_weighted(spark):
    rows = reading_rows(spark)
    by_day = rows.withColumn("xyt", packing.hour_key_to_day_key(F.col("xyt")))
    assert as_dict(bins.daily_rollup(bins.hourly_bins(rows))) == as_dict(bins.hourly_bins(by_day))


def test_split_delta_is_a_partition(spark):
    rows = reading_rows(spark)
    state = bins.hourly_bins(rows.filter(F.col("device_id") < 4))
    delta = bins.hourly_bins(rows.filter(F.col("device_id") >= 4))
    known, new = bins.split_delta(state, delta)
    assert known.count() + new.count() == delta.count() and known.count() > 0 and new.count() > 0
    assert known.join(state, bins.KEY, "left_anti").isEmpty()


def test_touch_marks_changed_rows_only(spark):
    old = spark.createDataFrame([(1, "a", 1.0, 1), (2, "a", 2.0, 1)], "xyt long, u string, sum_v double, n long")
    stored = bins.with_mean(old).withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    delta = spark.createDataFrame([(2, "a", 4.0, 1), (3, "a", 9.0, 1)], "xyt long, u string, sum_v double, n long")
    merged = device_stats.touch_changed(stored, bins.merge(old, delta), bins.KEY, datetime(2024, 1, 2))
    assert {r["xyt"]: (r["v"], str(r["updated_at"])) for r in merged.collect()} == {
        1: (1.0, "2024-01-01 00:00:00"), 2: (3.0, "2024-01-02 00:00:00"), 3: (9.0, "2024-01-02 00:00:00")}


def slot_bins(spark, rows):
    df = spark.createDataFrame(rows, "x long, y long, m long, t long, u string, v double")
    return df.select("u", "v", packing.pack(*[F.col(c) for c in "xymt"]).alias("xyt"))


def test_series_slots(spark):
    df = slot_bins(spark, [
        (1, 1, 0, 100, "a", 1.0), (1, 1, 0, 77, "a", 2.0), (1, 1, 0, 76, "a", 3.0), (1, 1, 1, 100, "a", 9.0),
        (2, 2, 0, 130, "a", 5.0), (3, 3, 1, 99, "b", 6.0),
    ])
    got = {(r["x"], r["u"]): r["vs"] for r in shaping.series(df, 100, shaping.HOUR_SLOTS).collect()}
    assert all(len(v) == 24 for v in got.values())
    assert (got[(1, "a")][0], got[(1, "a")][-1]) == (2.0, 9.0)
    assert got[(2, "a")] == [None] * 24
    assert got[(3, "b")][-2] == 6.0


def test_pivots(spark):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("s", "c", 3)], "r string, c string, v int")
    got = shaping.pivot(rows, "r", "c", "v", ["b", "a"])
    assert got.columns == ["r", "b", "a"]
    assert {tuple(r) for r in got.collect()} == {("r", 2, 1), ("s", None, None)}
    found = {r["r"]: r["cells"] for r in shaping.pivot_to_map(rows, "r", "c", "v").collect()}
    assert found == {"r": {"a": 1, "b": 2}, "s": {"c": 3}}


def brute_force(places, radius):
    out = {}
    for x, y, _ in places:
        near = [(n, -a, -b) for a, b, n in places if (a - x) ** 2 + (b - y) ** 2 < radius * radius]
        best = max(near)
        out[(x, y)] = (-best[1], -best[2])
    return out


@pytest.mark.parametrize("radius,span,count", [(1, 12, 60), (2, 20, 150), (3, 30, 200), (13, 120, 300), (26, 200, 400)])
def test_snapping_against_brute_force(spark, radius, span, count):
    rng = random.Random(radius)
    spots = Counter((rng.randrange(span), rng.randrange(span)) for _ in range(count))
    places = [(x, y, n * rng.randrange(1, 4)) for (x, y), n in spots.items()]
    df = spark.createDataFrame(places, "x long, y long, n long")
    got = {(r["x"], r["y"]): (r["to_x"], r["to_y"]) for r in snapping.targets(df, radius).collect()}
    assert got == brute_force(places, radius)


def test_snapping_one_hot_cell(spark):
    """Every pixel of one cell taken, one place holding most samples."""
    places = [(x, y, 1000 if (x, y) == (9, 9) else 1 + x % 3) for x in range(18) for y in range(18)]
    df = spark.createDataFrame(places, "x long, y long, n long")
    assert {(r["to_x"], r["to_y"]) for r in snapping.targets(df, 26).collect()} == {(9, 9)}


def test_snapping_a_quiet_cell_among_busy_ones(spark, monkeypatch):
    """Busy neighbours are not held against a quiet cell's places: a place meets a bounded number of cells."""
    rng = random.Random(7)
    places = [(x, y, (1 if 36 <= x < 54 and 36 <= y < 54 else 100) + rng.randrange(9)) for x in range(90) for y in range(90)]
    met = Counter()

    def counted(df, purpose, *more):
        table = written(df, purpose, *more)
        if purpose == "cells":
            met.update({(r["x"], r["y"]): r["count"] for r in table.groupBy("x", "y").count().collect()})
        return table

    written = snapping.written
    monkeypatch.setattr(snapping, "written", counted)
    df = spark.createDataFrame(places, "x long, y long, n long")
    got = {(r["x"], r["y"]): (r["to_x"], r["to_y"]) for r in snapping.targets(df, 26).collect()}
    assert got == brute_force(places, 26)
    # Of the 2121 pixels of a disk, at most those along its rim are met.
    assert max(met.values()) <= 8 * 26 and sum(met.values()) < 40 * len(places), (max(met.values()), sum(met.values()))


def test_devices_of_a_very_busy_place(spark):
    """100,000 devices at one place, and ids far apart, negative or missing at another."""
    busy, other = (packing.pack(*[F.lit(v).cast("long") for v in (x, 9, 0, 400000)]) for x in (5, 6))
    pairs = spark.range(200_000).select(busy.alias("xyt"), (F.col("id") % 100_000 * 3).alias("device_id"))
    ids = [2**62, -5, 0, 63, 64, None, -64, -5]
    pairs = pairs.union(spark.createDataFrame([(i,) for i in ids], "device_id long").select(other.alias("xyt"), "device_id"))
    words = bins.device_words(pairs)
    assert words.filter("x = 5").count() == 300_000 // 64 + 1
    again = bins.merge_words(words.union(words))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, words.collect()))
    rows = bins.devices_of_words(words)
    assert rows.filter("x = 5").select("device_id").distinct().count() == rows.filter("x = 5").count() == 100_000
    lists = {r["x"]: r["device_ids"] for r in bins.devices_of_places(pairs).collect()}
    assert lists == {5: list(range(0, 300_000, 3)), 6: [-64, -5, 0, 63, 64, 2**62]}


def test_snapped_bins_add_up(spark):
    hours = bins.hourly_bins(reading_rows(spark))
    moved = bins.regroup(snapping.snap_bins(hours, snapping.targets(bins.density(hours), 26)))
    total = lambda df: df.agg(F.sum("n")).first()[0]
    assert total(moved) == total(hours) and moved.count() < hours.count()
    same = bins.regroup(snapping.snap_bins(hours, snapping.targets(bins.density(hours), 0)))
    assert as_dict(same) == as_dict(hours)


def test_map_report_document(spark):
    now = datetime(2024, 1, 30, 20)
    hour = map_reports.reference_hour(now)
    assert hour == 474068
    rows = spark.createDataFrame([
        (1_000_000, 500_000, 0, hour, "lnd_7318u", 3, 334.0), (1_000_000, 500_000, 0, hour, "lnd_7318u", 2, 668.0),
        (1_000_000, 500_000, 0, hour - 1, "env_temp", 2, 20.0), (1_000_000, 500_000, 1, hour, "env_temp", 9, 99.0),
        (7, 7, 0, hour - 30, "env_temp", 4, 1.0),
    ], "x long, y long, m long, t long, unit string, device_id long, value double").select(
        "unit", "device_id", "value", packing.pack(*[F.col(c) for c in "xymt"]).alias("xyt"))
    report = map_reports.map_24h(*map_reports.report_inputs(rows), now)
    docs = report.collect()
    assert len(docs) == 1
    doc = docs[0]
    assert doc["device_ids"] == [2, 3]
    assert [d["unit"] for d in doc["data"]] == ["lnd_7318u", "env_temp"]
    day, hourly = doc["data"][0]["time_series"]
    assert (day["ss_per_epoch_timepart"], hourly["ss_per_epoch_timepart"]) == (86400, 3600)
    assert (len(day["values"]), len(hourly["values"])) == (30, 24)
    assert hourly["values"][-1] == 1.5 and hourly["value_newest"] == 1.5 and hourly["is_offline"] is True
    assert hourly["start_date"] == "2024-01-29T21:00:00Z" and hourly["end_date"] == "2024-01-30T20:00:00Z"
    assert doc["data"][0]["ui_display_unit_parts"].asDict() == {"ch": None, "si": "μSv/h", "mfr": "LND", "model": "7318"}
    everything = map_reports.map_24h(*map_reports.report_inputs(rows), now, False, False)
    assert everything.count() == 2


def test_map_report_with_snapping(spark):
    now = datetime(2024, 1, 30, 20)
    hour = map_reports.reference_hour(now)
    rows = spark.createDataFrame(
        [(1000, 1000, 0, hour, "env_temp", 1, 10.0)] * 3 + [(1010, 1000, 0, hour, "env_temp", 2, 50.0), (5000, 5, 0, hour, "env_temp", 3, 7.0)],
        "x long, y long, m long, t long, unit string, device_id long, value double",
    ).select("unit", "device_id", "value", packing.pack(*[F.col(c) for c in "xymt"]).alias("xyt"))
    inputs = map_reports.report_inputs(rows)
    docs = map_reports.map_24h(*inputs, now, radius=26).collect()
    got = {tuple(d["device_ids"]): [ts["values"][-1] for ts in d["data"][0]["time_series"]] for d in docs}
    assert got == {(1, 2): [20.0, 20.0], (3,): [7.0, 7.0]}
    assert map_reports.map_24h(*inputs, now).count() == 3
    daily = map_reports.map_daily(inputs[0], inputs[2], now, radius=26).collect()
    got = {tuple(d["device_ids"]): [v for v in d["data"][0]["time_series"][0]["values"] if v is not None] for d in daily}
    assert got == {(1, 2): [20.0], (3,): [7.0]}


def test_daily_report_anchor_and_end(spark):
    moment = datetime(2024, 1, 15, 13)
    hour = map_reports.reference_hour(moment)
    rows = spark.createDataFrame(
        [(1, 1, 0, hour // 24 * 24 + h, "env_temp", 1, float(h)) for h in range(24)],
        "x long, y long, m long, t long, unit string, device_id long, value double",
    ).select("unit", "device_id", "value", packing.pack(*[F.col(c) for c in "xymt"]).alias("xyt"))
    hours, _, pairs = map_reports.report_inputs(rows)
    series = {
        a: map_reports.map_daily(hours, pairs, moment, anchor=a).first()["data"][0]["time_series"][0]
        for a in ("reference", "start")
    }
    assert series["reference"]["values"] == [float(h) for h in range(13, 24)] + [None] * 13
    assert series["start"]["values"] == [float(h) for h in range(24)]
    assert series["start"]["end_date"] == "2024-01-15T22:59:59Z"
    assert "value_newest" not in series["start"].asDict()
