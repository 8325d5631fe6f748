from pyspark.sql import functions as F
import math
import random

import pytest

from pixelhour.functions import guards, packing, scalars, sql, units


def column(spark, values, type_, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize("text,expected", [
    ("1", 1.0), ("-1.5", -1.5), ("+.5", 0.5), ("5.", 5.0), ("1e3", 1000.0), (" 7 ", 7.0), ("inf", math.inf),
    ("-Infinity", -math.inf), ("", None), ("abc", None), ("1.5d", None), ("1f", None), ("0x1p3", None),
    ("1_0", None), ("1e", None), ("1e999", None), ("--1", None), (None, None),
])
def test_to_float(spark, text, expected):
    assert column(spark, [text], "string", guards.to_float) == [expected]


def test_float_accepts_every_nan(spark):
    assert all(math.isnan(v) for v in column(spark, ["nan", "NaN", "-nan", "+NAN"], "string", guards.to_float))


def test_checks_keep_null_and_numeric_excludes_infinity(spark):
    for check in (guards.is_float, guards.is_numeric, guards.is_timestamp, guards.is_boolean):
        assert column(spark, [None], "string", check) == [None]
    assert column(spark, ["inf", "nan", "12", "x"], "string", guards.is_numeric) == [False, True, True, False]
    assert column(spark, [float("nan"), 1.0, None], "double", guards.is_nan) == [True, False, None]


def test_booleans(spark):
    yes = ["t", "TRUE", " tr ", "y", "yes", "on", "1"]
    no = ["f", "fal", "n", "no", "off", "of", "0"]
    bad = ["o", "2", "yess", "", "null"]
    assert column(spark, yes, "string", guards.to_boolean) == [True] * len(yes)
    assert column(spark, no, "string", guards.to_boolean) == [False] * len(no)
    assert column(spark, bad, "string", guards.to_boolean) == [None] * len(bad)
    assert column(spark, yes + no, "string", guards.is_boolean) == [True] * 14
    assert column(spark, bad, "string", guards.is_boolean) == [False] * 5


def test_wall_clock_ignores_zone(spark):
    texts = ["2017-01-13T05:56:35Z", "2017-01-13 05:56:35+09:00", "2017-01-13T05:56:35.25+0900", "2017-01-13",
             "1998-19-250T04:35:59Z", "now", "2017-02-30", ""]
    got = [None if v is None else str(v) for v in column(spark, texts, "string", guards.to_wall_clock)]
    assert got == ["2017-01-13 05:56:35", "2017-01-13 05:56:35", "2017-01-13 05:56:35.250000", "2017-01-13 00:00:00",
                   None, None, None, None]


def test_pack_round_trip(spark):
    rng = random.Random(1)
    top = 1 << 21
    rows = [(rng.randrange(top), rng.randrange(top), rng.randrange(2), rng.randrange(top)) for _ in range(300)]
    rows += [(0, 0, 0, 0), (top - 1, top - 1, 1, top - 1)]
    df = spark.createDataFrame(rows, "x long, y long, m long, t long")
    packed = df.select("*", packing.pack(*[F.col(c) for c in "xymt"]).alias("k"))
    k = F.col("k")
    bad = packed.filter(
        (packing.decode_x(k) != F.col("x")) | (packing.decode_y(k) != F.col("y")) | (packing.decode_m(k) != F.col("m"))
        | (packing.decode_t(k) != F.col("t")) | (packing.decode_t(packing.hour_key_to_day_key(k)) != F.expr("t div 24"))
        | (packing.decode_x(packing.with_xy(k, F.col("y"), F.col("x"))) != F.col("y"))
        | (packing.clear_t(k).bitwiseOR(F.col("t")) != k)
    )
    assert bad.count() == 0


def test_projection_and_rounding(spark):
    assert column(spark, [180.0, -180.0, 0.0], "double", packing.lon_to_px) == [2097152, 0, 1048576]
    wrapped = packing.pack(packing.lon_to_px(F.lit(180.0)), F.lit(5), F.lit(0), F.lit(7))
    assert spark.range(1).select(packing.decode_x(wrapped)).first()[0] == 0
    assert column(spark, [0.0], "double", packing.lat_to_py) == [1048576]
    hours = column(spark, ["1970-01-01 12:30:00", "1970-01-01 12:30:01", "1970-01-01 13:30:00", "1970-01-01 12:29:59"],
                   "string", lambda c: packing.hour_number(c.cast("timestamp_ntz")))
    assert hours == [12, 13, 14, 12]
    lat, lon = 42.56, -70.78
    row = spark.range(1).select(
        packing.py_to_lat(packing.lat_to_py(F.lit(lat))), packing.px_to_lon(packing.lon_to_px(F.lit(lon)))
    ).first()
    assert abs(row[0] - lat) < 2e-4 and abs(row[1] - lon) < 2e-4


def test_unit_catalogue(spark):
    rows = {r["unit"]: r for r in units.catalogue(spark).collect()}
    assert len(rows) == 35 and len(units.MAP_UNITS) == 24 and len(units.STAT_UNITS) == 32
    assert rows["lnd_7128ec"]["cpm_divisor"] == 120.5 and rows["lnd_712u"]["cpm_divisor"] == 120.5
    assert rows["lnd_7318c"]["cpm_divisor"] == 334.0 and rows["lnd_78017w"]["cpm_divisor"] == 960.0
    assert rows["lnd_7318c"]["ch"] == "(γ)" and rows["lnd_7318u"]["ch"] is None and rows["lnd_7128ec"]["model"] == "7128"
    assert (rows["pms2_pm02_5"]["model"], rows["pms2_pm02_5"]["ch"]) == ("PMS5003 (2)", "PM 2.5")
    assert rows["bat_charge"]["si"] is None and rows["bat_charge"]["category"] == 5
    assert [rows[u]["category"] for u in ("opc_pm10_0", "pms_pm01_0", "pms2_pm01_0", "env_temp", "lnd_712")] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("unit,value,expected", [
    ("lnd_7318u", 0.0, False), ("lnd_7318u", 1e-9, True), ("lnd_7318u", 2.0**30, True), ("lnd_7318u", 2.0**30 + 1, False),
    ("env_press", 0.0, False), ("opc_pm02_5", 0.0, True), ("opc_pm02_5", -1.0, False), ("env_humid", 0.0, True),
    ("env_temp", -40.0, True), ("env_temp", float("nan"), True), ("env_temp", math.inf, True),
    ("lnd_712", float("nan"), False), ("pms_pm01_0", math.inf, False), ("bat_voltage", -5.0, True),
])
def test_range(spark, unit, value, expected):
    assert spark.range(1).select(units.in_range(F.lit(value), F.lit(unit))).first()[0] is expected


def test_scalars(spark):
    first = lambda *c: spark.range(1).select(*c).first()
    assert first(scalars.combined_mean(F.lit(2.0), F.lit(5.0), F.lit(1), F.lit(2)))[0] == 4.0
    assert tuple(first(scalars.scalar_max(F.lit(None).cast("int"), F.lit(3)), scalars.scalar_min(F.lit(4), F.lit(3)))) == (3, 3)
    vs = F.expr("array(null, null, 3.0, null, 1.0, null)")
    assert tuple(first(scalars.series_min(vs), scalars.series_max(vs), scalars.series_newest(vs))) == (1.0, 3.0, 1.0)
    assert tuple(first(scalars.series_is_offline(vs), scalars.series_is_offline(vs, "latest"))) == (True, False)
    assert first(scalars.series_newest(F.expr("array(cast(null as double))")))[0] is None
    assert first(scalars.series_is_offline(F.expr("array(cast(null as double))")))[0] is False
    assert first(scalars.series_is_offline(F.expr("cast(null as array<double>)")))[0] is None
    assert first(scalars.iso_text(F.expr("timestamp_ntz'2017-01-02 03:04:05.999'")))[0] == "2017-01-02T03:04:05Z"


def test_sql_functions_agree_with_the_expressions(spark):
    sql.register(spark)
    texts = ["1", "1.5d", "inf", "nan", "1e999", "x", "on", "2017-01-13T05:56:35Z", "1998-19-250T04:35:59Z", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    assert df.select(
        F.expr("is_float(s)"), F.expr("is_numeric(s)"), F.expr("is_timestamp(s)"), F.expr("is_boolean(s)")
    ).collect() == df.select(
        guards.is_float(s), guards.is_numeric(s), guards.is_timestamp(s), guards.is_boolean(s)).collect()
    names = spark.createDataFrame([(u, float(v)) for u in units.UNITS for v in (-1, 0, 5, 2**31, float("nan"))], "u string, v double")
    u, v = F.col("u"), F.col("v")
    left = names.select(
        F.expr("convert_cpm_to_usvh(v, u)"), F.expr("get_ui_display_category(u)"), F.expr("is_accepted_unit(u)"),
        F.expr("is_value_in_range_for_unit(v, u)"), F.expr("get_ui_display_unit_parts(u)"), F.expr("is_nan(v)"))
    right = names.select(units.to_usvh(v, u), units.category_of(u), units.is_map_unit(u), units.in_range(v, u),
                         units.parts_of(u), guards.is_nan(v))
    assert [str(r[:]) for r in left.collect()] == [str(r[:]) for r in right.collect()]
    row = spark.sql("""select scalar_max(null, 2.0D), scalar_min_int(3, 4), scalar_max_ts(null, timestamp_ntz'2020-01-01 00:00:00'),
        array_reverse(array(1D, null)), is_array_offline(array(null, null, 1D)), calc_dist_pythag(0D, 0D, 3D, 4D),
        calc_combined_mean(2D, 5D, 1, 2), xyt_convert_t_to_isostring(474068), xyt_convert_ism_to_m(null)""").first()
    assert (row[0], row[1], str(row[2]), row[3], row[4], row[5], row[6], row[7], row[8]) == (
        2.0, 3, "2020-01-01 00:00:00", [None, 1.0], True, 5.0, 4.0, "2024-01-30T20:00:00Z", None)
