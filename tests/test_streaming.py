import json
import time
from datetime import datetime

from pyspark.sql import functions as F

from conftest import SMALL
from pixelhour.operators import bins, device_stats, readings
from pixelhour.plans import map_reports
from pixelhour.sinks import writers
from pixelhour.sources import event_feed
from pixelhour.sources.measurements import MEASUREMENTS
from pixelhour.streaming import bin_state, device_state, jobs
from verification import registry

NOW = registry.NOW


def clock():
    return NOW


def rounded(df):
    return sorted((r["xyt"], r["u"], round(r["v"], 9), r["n"]) for r in df.collect())


def table(spark, folder, parts):
    rows = event_feed.measurements(event_feed.events(spark, SMALL)).withColumn("device_urn", F.lit(None).cast("string"))
    rows = rows.select(*MEASUREMENTS.fieldNames())
    # Arrival order unrelated to event time: every file holds early and late rows.
    for p in range(parts):
        rows.filter(F.abs(F.hash("id")) % parts == p).coalesce(1).write.mode("append").parquet(folder)
    return rows


def test_state_equals_batch_over_many_micro_batches(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    rows = table(spark, source, 4)
    stream = spark.readStream.schema(MEASUREMENTS).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.keep_hourly_state(stream, root, check, clock, None).awaitTermination()
    accepted = readings.explode_readings(rows, NOW)
    hourly = bins.hourly_bins(accepted)
    batches = spark.read.parquet(root)
    assert {r[0] for r in batches.select("batch_id").distinct().collect()} == set(range(4))
    by_level = batches.filter("level = 'hour'").select("batch_id").distinct().count(), batches.filter("level = 'day'").select("batch_id").distinct().count()
    assert by_level == (4, 4)
    assert rounded(bin_state.read(spark, root)) == rounded(hourly)
    assert rounded(bin_state.read(spark, root, bin_state.DAY)) == rounded(bins.daily_rollup(hourly))
    pairs = lambda df: {tuple(r) for r in df.collect()}
    assert pairs(bin_state.read_pairs(spark, root)) == pairs(accepted.select("xyt", "device_id").distinct())

    # Compacting changes nothing, of some days or all; nor does a run without new files.
    before, rows_before = rounded(bin_state.read(spark, root)), batches.count()
    bin_state.compact(spark, root, F.col("epoch_day") % 3 == 0)
    assert rounded(bin_state.read(spark, root)) == before
    bin_state.compact(spark, root)
    bin_state.compact(spark, root)
    assert rounded(bin_state.read(spark, root)) == before
    assert spark.read.parquet(root).count() < rows_before
    jobs.keep_hourly_state(stream, root, check, clock, None).awaitTermination()
    assert rounded(bin_state.read(spark, root)) == before

    day = map_reports.reference_hour(NOW) // 24
    part = bin_state.read(spark, root, days=range(day - 1, day + 1))
    assert rounded(part) == rounded(hourly.filter(bins.epoch_day(F.col("xyt")).between(day - 1, day)))
    shown = lambda df: sorted(map(str, map_reports.flat(df).collect()))
    assert shown(map_reports.map_24h_from_state(spark, root, NOW)) == shown(
        map_reports.map_24h(hourly, bins.daily_rollup(hourly), accepted.select("xyt", "device_id"), NOW))
    moment = registry.DAY_MOMENT
    assert shown(map_reports.map_daily_from_state(spark, root, moment)) == shown(
        map_reports.map_daily(hourly, accepted.select("xyt", "device_id"), moment))


def replay_last(check):
    """As if the query had stopped after its last write: Spark does not know that the batch is done."""
    commits = sorted((p for p in (check / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (check / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)


def test_replayed_batch_counts_once(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    rows = table(spark, source, 3)
    stream = spark.readStream.schema(MEASUREMENTS).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.keep_hourly_state(stream, root, check, clock, None).awaitTermination()
    written = spark.read.parquet(root).count()
    replay_last(tmp_path / "check")
    jobs.keep_hourly_state(stream, root, check, clock, None).awaitTermination()
    assert spark.read.parquet(root).count() > written  # it was written twice
    assert rounded(bin_state.read(spark, root)) == rounded(bins.hourly_bins(readings.explode_readings(rows, NOW)))


def test_replayed_device_statistics(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = table(spark, source, 3)
    stream = spark.readStream.schema(MEASUREMENTS).option("maxFilesPerTrigger", 1).parquet(source)
    start = lambda: jobs.keep_device_stats(stream, str(tmp_path / "stats"), str(tmp_path / "check"), None).awaitTermination()
    start()
    replay_last(tmp_path / "check")
    start()
    shown = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert shown(device_state.read_stats(spark, str(tmp_path / "stats"))) == shown(device_stats.device_stats(rows))


def test_device_texts_follow_the_newest_load(spark, tmp_path, measure):
    """A later load replaces texts; a device silent about its test mode is not testing; others stay."""
    source = str(tmp_path / "in")
    at = "2024-01-02 03:00:00"
    loads = [
        measure((1, 7, {"dev_test": True, "dev_label": "a"}, at), (2, 8, {"dev_test": True}, at)),
        measure((3, 7, {"dev_label": "b"}, at)),
    ]
    for load in loads:
        load.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(loads[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        jobs.keep_device_texts(stream, str(tmp_path / "out"), str(tmp_path / "c"), clock, None).awaitTermination()
    got = {(r["device_id"], r["unit"]): (r["val"], r["ts"]) for r in device_state.read_texts(spark, str(tmp_path / "out")).collect()}
    sent = datetime(2024, 1, 2, 3)
    assert got == {(7, "dev_label"): ("b", sent), (7, "dev_test"): ("false", NOW), (8, "dev_test"): ("true", sent)}


def loads_of(spark, folder, rows):
    """(least id, greatest id, rows, files) of each micro-batch of the two loads of so many events."""
    spark.range(rows).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-30 10:00:00' as ts", "id % 7 as user_id", "'click' as event_type",
        "1.5D as value", "'{}' as props",
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    seen = {}

    def handle(batch, batch_id):
        seen[batch_id] = tuple(batch.agg(F.min("id"), F.max("id"), F.count("id"), F.countDistinct("file")).first())

    stream = registry.load_stream(spark, str(folder)).select("id", F.input_file_name().alias("file"))
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return seen


def test_a_load_is_one_micro_batch_of_many_files(spark, tmp_path):
    first, second = loads_of(spark, tmp_path, 400).values()
    assert first[:3] == (0, 199, 200) and second[:3] == (200, 399, 200)
    assert first[3] > 1 and second[3] > 1


def test_loads_of_few_rows_stay_apart(spark, tmp_path):
    first, second = loads_of(spark, tmp_path, 3).values()
    assert first[:3] == (0, 1, 2) and second[:3] == (2, 2, 1)


def test_batch_time_is_the_same_in_a_retry(spark, tmp_path):
    """Without a clock the run's time is the micro-batch's, which Spark keeps with its offsets."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(json.dumps({"Message": "m"}))
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "body")
    root = str(tmp_path / "out")
    for _ in range(2):
        jobs.archive_messages(stream, root, str(tmp_path / "c"), None, None).awaitTermination()
        folders = {str(p.relative_to(root)) for p in (tmp_path / "out").glob("*/*/*/*")}
        assert len(folders) == 1
        replay_last(tmp_path / "c")
        time.sleep(1)
    times = {r[0] for r in writers.read_raw_archive(spark, root).select("minute").collect()}
    assert len(times) == 1 and writers.read_raw_archive(spark, root).count() == 1


def test_empty_state(spark, tmp_path):
    assert bin_state.read(spark, str(tmp_path / "none")).count() == 0
    assert bin_state.read_pairs(spark, str(tmp_path / "none")).count() == 0
    assert bin_state.read(spark, str(tmp_path / "none"), days=range(5)).count() == 0


def test_windowed_variant_closes_hours(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = table(spark, source, 1)
    stream = spark.readStream.schema(MEASUREMENTS).parquet(source)
    query = (
        jobs.windowed_hours(stream, NOW, "90 days").writeStream.outputMode("update").format("memory")
        .queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rounded(spark.table("windowed")) == rounded(bins.hourly_bins(readings.explode_readings(rows, NOW)))


def test_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = lambda i: json.dumps({"Timestamp": "t", "Message": json.dumps({"version": 1, "payload": {"i": i, "s": "a\nb"}})})
    for f in range(3):
        (tmp_path / "in" / f"{f}.txt").write_text("\n".join(body(10 * f + i) for i in range(5)))
    stream = spark.readStream.option("maxFilesPerTrigger", 2).text(str(tmp_path / "in")).withColumnRenamed("value", "body")
    root = str(tmp_path / "out")
    for _ in range(2):
        jobs.archive_messages(stream, root, str(tmp_path / "c"), clock, None).awaitTermination()
    back = writers.read_raw_archive(spark, root).collect()
    assert sorted(json.loads(r["value"])["payload"]["i"] for r in back) == sorted(10 * f + i for f in range(3) for i in range(5))
    folders = {str(p.relative_to(root)) for p in (tmp_path / "out").glob("*/*/*")}
    assert folders == {"date=2024-01-30/hour=20/minute=00"}


def test_enrichment(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = json.dumps({"Message": json.dumps({"version": 1, "payload": {"device": 4, "loc_lat": 1, "loc_lon": 2, "x": "y"}})})
    (tmp_path / "in" / "a.txt").write_text(body)
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "body")
    jobs.enrich_messages(stream, str(tmp_path / "out"), str(tmp_path / "c"), clock, None).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row["device"], row["extra"], str(row["index_date"])) == (4, {"x": "y"}, "2024-01-30")
    assert row["geo_point"].asDict() == {"lat": 1.0, "lon": 2.0} and row["timestamp"] == datetime(2024, 1, 30, 20)
