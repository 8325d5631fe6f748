import json
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import MEDIUM
from pixelhour.functions import packing
from pixelhour.operators import readings
from pixelhour.sources import event_feed, measurements, payloads
from verification import registry

NOW = datetime(2024, 1, 30, 20)
AT = "2024-01-30 10:00:00"
GOOD = {"loc_lat": 42.5, "loc_lon": -70.8, "when_captured": "2024-01-30T09:00:00Z", "lnd_7318u": 30}


def variant(**changes):
    return {k: v for k, v in {**GOOD, **changes}.items() if v is not ...}


@pytest.mark.parametrize("payload,count", [
    (GOOD, 1),
    (variant(env_temp="21.5", opc_pm02_5=0, note=1), 3),
    (variant(lnd_7318u="abc"), 0),
    (variant(lnd_7318u=0), 0),
    (variant(env_temp="NaN", lnd_7318u=...), 1),
    (variant(bat_charge=5, lnd_7318u=...), 0),
    (variant(loc_lat=85.06), 0),
    (variant(loc_lat="42.5"), 1),
    (variant(loc_lat="NaN"), 0),
    (variant(loc_lat=90), 0), (variant(loc_lat=1e300, loc_lon="-Infinity"), 0),
    (variant(loc_lat=...), 0),
    (variant(loc_lat=None), 0),
    (variant(loc_lat=0.5, loc_lon=-0.5), 0),
    (variant(loc_lat=0.5, loc_lon=2), 1),
    (variant(when_captured=...), 1),
    (variant(when_captured=None), 0),
    (variant(when_captured="1998-19-250T04:35:59Z"), 0),
    (variant(when_captured="2011-03-10T23:59:59Z"), 0),
    (variant(when_captured="2011-03-11T00:00:00Z"), 1),
    (variant(when_captured="2024-02-01T20:00:00Z"), 1),
    (variant(when_captured="2024-02-01T20:00:01Z"), 0),
    (variant(gateway_received="bad"), 0),
    (variant(gateway_received="2024-01-30T09:30:00Z"), 1),
    ("[1]", 0), ("nope", 0), ("{}", 0),
    ('{"loc\\u005flat":42.5,"loc_lon":-70.8,"env_temp":1}', 1),
])
def test_acceptance(measure, payload, count):
    assert readings.explode_readings(measure((1, 7, payload, AT)), NOW).count() == count


@pytest.mark.parametrize("extra,motion", [
    ({}, 0), ({"loc_motion": False}, 1), ({"loc_motion": None}, 1), ({"dev_test": True}, 1), ({"dev_test": False}, 0),
    ({"dev_test": None}, 1), ({"dev_test": "off"}, 0), ({"dev_test": "maybe"}, 1),
    ({"dev_test": False, "loc_motion": 1}, 1),
])
def test_motion(measure, extra, motion):
    rows = readings.explode_readings(measure((1, 7, {**GOOD, **extra}, AT)), NOW)
    assert rows.select(packing.decode_m(F.col("xyt"))).first()[0] == motion


@pytest.mark.parametrize("changes,hour", [
    ({}, "2024-01-30 09:00:00"),
    ({"when_captured": ..., "gateway_received": "2024-01-30T08:00:00Z"}, "2024-01-30 08:00:00"),
    ({"gateway_received": "2024-01-30T08:00:00Z"}, "2024-01-30 09:00:00"),
    ({"when_captured": ...}, AT),
])
def test_event_time(measure, changes, hour):
    row = readings.explode_readings(measure((1, 7, variant(**changes), AT)), NOW).first()
    assert str(row["event_time"]) == hour


def test_last_of_equal_keys_wins(spark, measure):
    text = '{"loc_lat":1,"loc_lat":42.5,"loc_lon":-70.8,"env_temp":1,"env_temp":2}'
    rows = readings.explode_readings(measure((1, 7, text, AT)), NOW).collect()
    assert [r["value"] for r in rows] == [2.0]


def test_golden_counts(spark):
    """FIXTURES.md section 3."""
    rows = registry.accepted(spark, MEDIUM).groupBy("unit", packing.decode_m(F.col("xyt")).alias("m")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))
    assert {(r["unit"], r["m"]): (r["n"], r["s"]) for r in rows.collect()} == {
        ("env_temp", 0): (1555, 73594.07), ("env_temp", 1): (121, 4554.97),
        ("lnd_7128ec", 0): (1557, 72932.05), ("lnd_7128ec", 1): (126, 7080.46),
        ("lnd_7318u", 0): (1578, 82571.05), ("lnd_7318u", 1): (102, 4503.32),
        ("opc_pm02_5", 0): (1553, 75947.39), ("opc_pm02_5", 1): (129, 6669.54),
    }


@pytest.mark.parametrize("body,device,reason", [
    ('{"device_id":1337}', 1337, None), ('{"device":1337}', 1337, None), ('{"device_id":1,"device":2}', 1, None),
    ('{"device_id":" 12 "}', 12, None), ('{"device_id":null,"device":5}', 5, None),
    ('{"lora_snr":7}', None, "missing_device"), ('{}', None, "missing_device"), ('{"device_id":"x"}', None, "bad_type"),
    ('{"device":1.5}', None, "bad_type"), ('{"device_id":1,"device":"x"}', 1, "bad_type"),
    ('{"device_id":1', None, "malformed"), ("[1]", None, "malformed"), ("", None, "malformed"),
])
def test_intake(spark, body, device, reason):
    row = measurements.judge_posts(spark.createDataFrame([(body,)], "payload string")).first()
    assert row["reject_reason"] == reason
    if reason is None:
        assert row["device_id"] == device


def test_envelope_keeps_the_payload(spark):
    posts = spark.createDataFrame([('{"device":3856112813,"v":1.50,"s":"ü"}',)], "payload string")
    value = measurements.publish_envelopes(measurements.accept_posts(posts)).first()["value"]
    assert json.loads(value) == {"version": 1, "payload": {"device": 3856112813, "v": 1.5, "s": "ü"}}
    assert "1.50" in value


def test_json_lines_source(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text('{"device":1,"dev_test":false}\n{}\n {"device":2} \t\n')
    loaded = payloads.with_fields(measurements.read_json_lines(spark, str(path)))
    assert [(r["fields"].get("device"), r["fields"]["dev_test"]) for r in loaded.collect()] == [
        ("1", "true"), (None, "true"), ("2", "true")]
    path.write_text('{"device":1}\nbroken\n')
    with pytest.raises(PySparkException):
        measurements.read_json_lines(spark, str(path)).collect()


def test_mappable_view(measure):
    rows = measure(
        (1, 1, {"latitude": 42.5, "longitude": "-70.7", "captured_at": "2017-01-13T05:56:35+09:00"}, AT),
        (2, 1, {"latitude": None, "longitude": 1, "captured_at": "2017-01-13T05:56:35Z"}, AT),
        (3, 1, {"latitude": 1, "longitude": 1}, AT),
    )
    got = measurements.mappable_view(rows).collect()
    assert [(r["id"], str(r["captured_at"]), tuple(r["location"])) for r in got] == [
        (1, "2017-01-12 20:56:35", (42.5, -70.7))]


def test_marks(measure):
    rows = measure(*[(i, 1, GOOD, f"2024-01-30 10:0{i}:00") for i in range(5)])
    assert [r["id"] for r in readings.after_id(rows, 2).orderBy("id").collect()] == [3, 4]
    assert readings.after_id(rows, None).count() == 4
    assert readings.after_time(rows, datetime(2024, 1, 30, 10, 3)).count() == 1
    assert readings.after_time(rows, None).count() == 5


def test_bad_months(spark):
    docs = spark.createDataFrame([("1998-19-250T04:35:59Z",), ("2021-12-01",), (None,), ("x",)], "when_captured string")
    assert [r[0] for r in readings.drop_bad_months(docs).collect()] == ["2021-12-01", None, "x"]


def test_feed_drops_no_row(spark):
    events = event_feed.events(spark, MEDIUM)
    for build in (event_feed.measurements, event_feed.posts, event_feed.legacy_measurements, event_feed.service_payloads):
        assert build(events).filter(F.col("payload").isNotNull()).count() == events.count()


def test_ids_committed_late_are_not_lost(spark):
    rows = spark.createDataFrame([(i, "x") for i in (-70, -1, 0, 1, 63, 64, 2**62, None)], "id long, device string")
    seen = readings.seen_ids(rows.filter("id in (-1, 0, 63)"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(readings.not_seen(rows, seen)) == [-70, 1, 64, 2**62]
    more = readings.merge_seen(seen.union(readings.seen_ids(rows.filter("id in (1, -70)"))))
    left = readings.not_seen(rows, more)
    assert ids(left) == [64, 2**62] and left.columns == ["id", "device"]
    assert ids(readings.not_seen(rows, seen.limit(0))) == [-70, -1, 0, 1, 63, 64, 2**62]
