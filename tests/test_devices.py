from datetime import datetime

from pixelhour.operators import device_details, device_stats
from pixelhour.plans import device_report
from pixelhour.sources import devices

NOW = datetime(2024, 1, 30, 20)


def stats_of(df):
    return {
        (r["device_id"], r["unit"]): (r["min"], r["max"], r["val"], r["n"], str(r["min_ts"]), str(r["max_ts"]))
        for r in df.collect()
    }


def test_stats_and_latest_value(measure):
    rows = measure(
        (1, 7, {"env_temp": 5, "loc_lat": 1}, "2024-01-01 00:00:00"),
        (3, 7, {"env_temp": 9}, "2024-01-02 00:00:00"),
        (2, 7, {"env_temp": 1}, "2024-01-02 00:00:00"),
        (4, 7, {"env_temp": "x", "lnd_712": 0}, "2024-01-03 00:00:00"),
        (5, 8, {"dev_label": "a", "note": 3}, "2024-01-03 00:00:00"),
    )
    assert stats_of(device_stats.device_stats(rows)) == {
        (7, "env_temp"): (1.0, 9.0, 9.0, 3, "2024-01-01 00:00:00", "2024-01-02 00:00:00"),
        (7, "loc_lat"): (1.0, 1.0, 1.0, 1, "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
    }


def test_merge_keeps_ranges_and_takes_the_newer_load(measure):
    first = device_stats.device_stats(measure(
        (1, 7, {"env_temp": 5}, "2024-01-05 00:00:00"), (2, 8, {"env_temp": 4}, "2024-01-05 00:00:00")))
    second = device_stats.device_stats(measure(
        (3, 7, {"env_temp": 50}, "2024-01-01 00:00:00"), (4, 9, {"env_temp": 6}, "2024-01-06 00:00:00")))
    merged = stats_of(device_stats.merge_device_stats(first, second))
    assert merged[(7, "env_temp")] == (5.0, 50.0, 50.0, 2, "2024-01-01 00:00:00", "2024-01-05 00:00:00")
    assert set(merged) == {(7, "env_temp"), (8, "env_temp"), (9, "env_temp")}


def test_meta(measure):
    rows = measure(
        (1, 7, {"dev_label": "old", "dev_test": True}, "2024-01-01 00:00:00"),
        (2, 7, {"dev_label": "new"}, "2024-01-02 00:00:00"),
        (3, 7, {"dev_label": None}, "2024-01-03 00:00:00"),
        (4, 8, {"dev_test": None}, "2024-01-01 00:00:00"),
    )
    got = {(r["device_id"], r["unit"]): (r["val"], str(r["ts"])) for r in device_stats.device_meta(rows, NOW).collect()}
    assert got == {
        (7, "dev_label"): ("new", "2024-01-02 00:00:00"), (7, "dev_test"): ("true", "2024-01-01 00:00:00"),
        (8, "dev_test"): ("false", "2024-01-30 20:00:00"),
    }
    state = device_stats.device_meta(rows, NOW)
    later = device_stats.device_meta(measure((9, 7, {"env_temp": 1}, "2024-02-01 00:00:00")), datetime(2024, 2, 2))
    merged = {(r["device_id"], r["unit"]): r["val"] for r in device_stats.merge_device_meta(state, later).collect()}
    assert merged == {(7, "dev_label"): "new", (7, "dev_test"): "false", (8, "dev_test"): "false"}


def test_report(measure):
    rows = measure(
        (1, 7, {"env_temp": 5, "lnd_7318u": 3, "bat_voltage": 4, "dev_label": "x"}, "2024-01-01 00:00:00"),
        (2, 8, {"env_temp": 5}, "2024-01-01 00:00:00"))
    report = device_report.device_stats_report(device_stats.device_stats(rows), device_stats.device_meta(rows, NOW))
    docs = {r["device_id"]: r for r in report.collect()}
    assert [u["unit"] for u in docs[7]["units"]] == ["lnd_7318u", "env_temp", "bat_voltage"]
    assert docs[7]["dev_label"] == "x" and docs[8]["dev_label"] is None and docs[8]["dev_test"] == "false"
    assert docs[7]["units"][0]["stats"]["min_ts"] == "2024-01-01T00:00:00Z"


def documents(spark, rows):
    return spark.createDataFrame(rows, "device long, device_urn string, device_sn string")


def test_details_pick_the_telling_term(spark):
    rows = [(1, "urn:1", "sn-1")] * 5 + [(1, "urn:shared", None)] * 6 + [(2, "urn:2", "sn-1")] * 2
    rows += [(2, "urn:shared", "sn-2")] * 4 + [(3, None, None)] * 2 + [(None, "urn:9", "sn-9")] * 9
    docs = documents(spark, rows)
    got = {r["device"]: (r["device_urn"], r["device_sn"]) for r in device_details.device_details(docs).collect()}
    # urn:1 is all device 1's, urn:shared is not; urn:2 has too few documents to count.
    assert got == {1: ("urn:1", "sn-1"), 2: ("urn:shared", "sn-2"), 3: (None, None)}
    assert [r["device"] for r in device_details.top_devices(docs, 2).collect()] == [1, 2]


def test_backfill_fills_only_gaps(spark):
    docs = documents(spark, [(1, None, "own"), (1, "own", None), (5, None, None), (None, None, None)])
    details = documents(spark, [(1, "urn:1", "sn-1"), (2, "urn:2", "sn-2")])
    got = device_details.backfill(docs, details)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {
        (1, "urn:1", "own"), (1, "own", "sn-1"), (5, None, None), (None, None, None)}


def test_details_of_every_device(spark):
    docs = documents(spark, [(d, f"urn:{d}", None if k else f"sn-{d}") for d in range(1500) for k in range(4)])
    got = device_details.backfill(docs, device_details.device_details(docs, min_documents=1))
    assert got.filter("device_sn is null").count() == 0 and got.count() == 6000


def test_device_table(spark):
    empty = spark.createDataFrame([], devices.DEVICES)
    assert devices.list_devices(empty).count() == 0
    table = spark.createDataFrame(
        [(74, (135.764331, 34.995197), "Kyoto", "{}", datetime(2024, 1, 1), datetime(2024, 1, 1), "a-b")], devices.DEVICES)
    row = devices.find_device(table, "a-b").first()
    assert row["location"].asDict() == {"longitude": 135.764331, "latitude": 34.995197}
    assert devices.find_device(table, "nope").count() == 0
    assert "numeric_id" not in devices.list_devices(table).columns
