"""The physical plans are the ones meant: no Python, no cross joins, hash aggregation, one parse, pruned scans."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from pixelhour.operators import readings
from pixelhour.session import written
from pixelhour.streaming import bin_state
from verification import registry


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


WRITING = {"csv_dump", "doc_rewrite", "monthly_report_counts", "yearly_compaction_counts", "retention_remaining"}
PLANNED = [n for n in registry.QUERIES if n not in WRITING and not n.startswith(("stream_", "raw_archive"))]


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SMALL))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonEval|ArrowEval|MapInPandas|BatchScan.*python", plan)


@pytest.mark.parametrize("name", ["hourly_bins", "daily_rollup", "device_stats", "merge_device_stats", "series_24h",
                                  "series_devtest", "snap_r26", "location_devices", "merge_hourly"])
def test_bulk_aggregation_is_hash_based(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SMALL))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_payload_is_parsed_once(spark):
    stored = written(registry.raw(spark, SMALL), "raw")
    rows = readings.explode_readings(stored, registry.NOW).filter(F.expr("xyt & 2097151") > 10)
    assert plan_of(rows).count("from_json") == 1
    assert plan_of(readings.annotate(stored, registry.NOW).filter("place_ok")).count("from_json") == 1


def test_scan_reads_only_what_is_needed(spark):
    stored = written(registry.raw(spark, SMALL), "raw")
    plan = plan_of(readings.explode_readings(stored, registry.NOW).groupBy("xyt", "unit").count())
    assert set(re.search(r"ReadSchema: struct<(.*?)>", plan).group(1).split(",")) == {
        "payload:string", "created_at:timestamp_ntz"}


def test_state_reads_open_only_their_days(spark, tmp_path):
    root = str(tmp_path / "state")
    groups = bin_state.grouped(registry.accepted(spark, SMALL))
    for batch in range(2):
        bin_state.append(groups, root, batch)
    files = bin_state.read(spark, root, days=range(19750, 19752)).inputFiles()
    assert files and {re.search(r"epoch_day=(\d+)", f).group(1) for f in files} == {"19750", "19751"}
    assert {re.search(r"level=(\w+)/", f).group(1) for f in files} == {"hour"}
    later = plan_of(bin_state.read(spark, root, days=19752))
    assert re.search(r"PartitionFilters: \[[^\]]*epoch_day#\d+ >= 19752", later)


def test_report_reads_the_written_bins_not_the_payloads(spark):
    plan = plan_of(registry.map_24h(spark, SMALL))
    assert "from_json" not in plan
