import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pixelhour.functions import guards
from pixelhour.operators import documents
from pixelhour.sinks import writers

NOW = datetime(2024, 1, 30, 20, 5, 6)


def enriched(spark, *payloads_):
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads_)]
    return documents.enrich(spark.createDataFrame(rows, "id int, payload string"), NOW)


def test_mapping_has_every_field():
    assert len(documents.MAPPED_FIELDS) == len(set(documents.MAPPED_FIELDS)) == 82


def test_time_and_place(spark):
    got = enriched(
        spark, {"when_captured": "a", "service_uploaded": "b"}, {"when_captured": None, "service_uploaded": "b"},
        {"when_captured": False}, {"when_captured": ""}, {"loc_lat": 1}, {"loc_lat": 1, "loc_lon": None},
    ).orderBy("id").collect()
    assert [r["document_time"] for r in got[:4]] == ["a", "b", "2024-01-30T20:05:06Z", ""]
    assert got[4]["location"] is None and got[5]["location"].asDict() == {"lat": "1", "lon": None}
    assert got[0]["index_date"] == date(2024, 1, 30)


def test_unwrap(spark):
    body = json.dumps({"Timestamp": "t", "Message": json.dumps({"version": 1, "payload": {"device": 5, "s": "x\"y"}})})
    df = spark.createDataFrame([(body,)], "body string")
    assert json.loads(documents.unwrap(df).first()["payload"]) == {"device": 5, "s": 'x"y'}
    assert json.loads(documents.message_text(df).first()["value"])["version"] == 1


def test_typed_fields(spark):
    row = documents.typed_projection(enriched(spark, {
        "device": "12", "pms_c00_30": 7.9, "env_temp": "21.5", "bat_charge": "bad", "opc_pm01_0": "NaN",
        "dev_test": "true", "dev_motion": False, "loc_name": "n" * 1025, "device_sn": "s" * 1024,
        "when_captured": "1998-19-250T04:35:59Z", "service_uploaded": "2024-01-02T03:04:05Z",
        "loc_lat": 91, "loc_lon": 5, "other": {"a": 1}, "long_note": "x" * 2000,
    }), ["id"]).first()
    assert (row["device"], row["pms_c00_30"], row["env_temp"]) == (12, 7, 21.5)
    assert row["bat_charge"] is None and row["opc_pm01_0"] is None
    assert row["dev_test"] is True and row["dev_motion"] is False
    assert len(row["loc_name"]) == 1025 and len(row["device_sn"]) == 1024
    assert row["when_captured"] is None and str(row["service_uploaded"]) == "2024-01-02 03:04:05"
    assert row["timestamp"] is None and row["geo_point"] is None and row["loc_lat"] == 91.0
    assert row["extra"] == {"other": '{"a":1}', "long_note": "x" * 2000}
    assert row["ignored_fields"] == ["loc_name", "long_note"]


def test_document_dates(spark):
    texts = ["2024-01-30T09:00:00+09:00", "2024-01-30T09:00:00Z", "2024-01-30", "1706605200000", "2024-01-30T09:00:00.5-0130", "soon", "1998-19-250T04:35:59Z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [str(r["d"]) for r in rows.select("i", guards.to_instant(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == ["2024-01-30 00:00:00", "2024-01-30 09:00:00", "2024-01-30 00:00:00", "2024-01-30 09:00:00",
                   "2024-01-30 10:30:00.500000", "None", "None"]


def test_csv_dump_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", twice\nnext', datetime(2024, 1, 2, 3, 4, 5, 678000)), (2, None, None), (3, "ü,;\\", datetime(1999, 1, 1))]
    df = spark.createDataFrame(rows, "id long, payload string, created_at timestamp_ntz")
    writers.write_csv_dump(df.repartition(2), str(tmp_path / "dump"))
    files = list((tmp_path / "dump").glob("*.csv.gz"))
    assert len(files) >= 2
    back = spark.read.schema(df.schema).option("header", True).option("multiLine", True).option("escape", '"').option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(str(tmp_path / "dump"))
    assert sorted(map(tuple, back.collect())) == rows


def test_reports_keep_nulls(spark, tmp_path):
    df = spark.sql("select 1.5d lat, cast(null as string) dev_label, array(1.0d, null) values")
    writers.write_report(df, str(tmp_path / "r"))
    line = next((tmp_path / "r").glob("*.json")).read_text().strip()
    assert json.loads(line) == {"lat": 1.5, "dev_label": None, "values": [1.0, None]}


def test_daily_report_replaces_its_date_only(spark, tmp_path):
    root = str(tmp_path / "daily")
    df = lambda v: spark.sql(f"select {v} as v")
    writers.write_daily_report(df(1), root, date(2024, 1, 2))
    writers.write_daily_report(df(2), root, date(2024, 1, 3))
    writers.write_daily_report(df(3), root, date(2024, 1, 2))
    assert {p.name: [json.loads(f.read_text())["v"] for f in p.glob("*.json")]
            for p in (tmp_path / "daily" / "year=2024" / "month=01").iterdir()} == {"day=02": [3], "day=03": [2]}


def test_monthly_report(spark, tmp_path):
    df = spark.sql("""select cast(concat('2024-0', 1 + id % 4, '-', lpad(1 + id % 28, 2, '0')) as timestamp_ntz) service_uploaded, id
                      from range(400)""")
    writers.write_monthly_report(df, str(tmp_path / "m"), datetime(2024, 2, 20), datetime(2024, 3, 1), ["service_uploaded", "id"])
    folders = sorted(p.name for p in (tmp_path / "m").glob("month=*"))
    assert folders == ["month=2024-02-01", "month=2024-03-01"]
    months = {}
    for name in folders:
        for file in sorted((tmp_path / "m" / name).glob("*.csv")):
            months.setdefault(name, []).extend(line for line in file.read_text().splitlines()[1:])
    assert all(len(v) == 100 for v in months.values())
    for lines in months.values():
        keys = [(line.split(",")[0], int(line.split(",")[1])) for line in lines]
        assert keys == sorted(keys)
    december = writers.monthly_rows(df, datetime(2023, 12, 31), datetime(2023, 12, 31))
    assert december.count() == 0


def test_compaction_and_retention(spark, tmp_path):
    daily, yearly = str(tmp_path / "d"), str(tmp_path / "y")
    rows = spark.sql("select id, date_add(date'2023-12-20', cast(id % 20 as int)) index_date from range(200)")
    writers.write_daily_documents(rows, daily, 0)
    writers.write_daily_documents(rows, daily, 0)
    assert spark.read.parquet(daily).count() == 200
    for year in (2023, 2024, 2024):
        writers.compact_year(spark, daily, yearly, year)
    got = {r["year"]: r["count"] for r in spark.read.parquet(yearly).groupBy("year").count().collect()}
    assert got == {2023: 120, 2024: 80}
    left = documents.without_year(spark.read.parquet(daily), 2023)
    assert left.count() == 80 and left.agg(F.min("index_date")).first()[0] == date(2024, 1, 1)


def test_retired_year(spark, tmp_path):
    daily, yearly = str(tmp_path / "daily"), str(tmp_path / "yearly")
    rows = spark.range(40).select("id", F.date_add(F.lit("2023-12-20").cast("date"), (F.col("id") % 20).cast("int")).alias("index_date"))
    writers.write_daily_documents(rows, daily, 0)
    files = lambda: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "daily").glob("index_date=2024*/*/*.parquet")}
    before = files()
    writers.compact_year(spark, daily, yearly, 2023)
    writers.write_daily_documents(rows.limit(1), daily, 1)  # a day that grew since
    with pytest.raises(ValueError, match="2023-12-20"):
        writers.retire_year(spark, daily, yearly, 2023)
    assert spark.read.parquet(daily).count() == 41
    writers.compact_year(spark, daily, yearly, 2023)
    assert len(writers.retire_year(spark, daily, yearly, 2023)) == 12
    assert writers.retire_year(spark, daily, yearly, 2023) == []
    left = spark.read.parquet(daily)
    assert left.count() == 16 and left.filter("year(index_date) <> 2024").isEmpty()
    assert files() == before and spark.read.parquet(yearly).count() == 25
