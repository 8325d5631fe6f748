"""The scalar functions under their established names, for use in SQL text.

``register(spark)`` creates temporary SQL functions. Spark inlines their bodies
into the calling plan, so they cost what the expression costs. SQL functions
cannot be overloaded: ``scalar_max`` / ``scalar_min`` take DOUBLE, with ``_int``
and ``_ts`` forms beside them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pixelhour.functions import guards, packing, scalars, units


def _words(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _cases(values: dict[str, object], otherwise: str, show=str) -> str:
    groups: dict[object, list[str]] = {}
    for name, value in values.items():
        groups.setdefault(value, []).append(name)
    arms = " ".join(f"WHEN u IN ({_words(names)}) THEN {show(value)}" for value, names in groups.items())
    return f"CASE {arms} ELSE {otherwise} END"


def _part(index: int, name: str) -> str:
    given = {u: units.display_parts(u)[index] for u in units.UNITS if units.display_parts(u)[index] is not None}
    return f"'{name}', {_cases(given, 'CAST(NULL AS STRING)', lambda v: chr(39) + v + chr(39))}"


# (name, parameters, result, body); later functions may call earlier ones.
FUNCTIONS = [
    ("array_reverse", "a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "reverse(a)"),
    ("convert_ts_to_isostring", "ts TIMESTAMP_NTZ", "STRING", f'date_format(ts, "{scalars.ISO_FORMAT}")'),
    ("convert_tstz_to_isostring", "ts TIMESTAMP", "STRING", f'date_format(ts, "{scalars.ISO_FORMAT}")'),
    ("calc_dist_pythag", "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "hypot(x1 - x2, y1 - y2)"),
    *[(f"scalar_{kind}{suffix}", f"a {type_}, b {type_}", type_, f"{call}(a, b)")
      for kind, call in (("max", "greatest"), ("min", "least"))
      for suffix, type_ in (("", "DOUBLE"), ("_int", "BIGINT"), ("_ts", "TIMESTAMP_NTZ"))],
    ("is_nan", "v DOUBLE", "BOOLEAN", "CASE WHEN v IS NOT NULL THEN isnan(v) END"),
    ("is_numeric", "s STRING", "BOOLEAN", f"s RLIKE r'{guards.NUMERIC_PATTERN}'"),
    ("is_float", "s STRING", "BOOLEAN",
     f"s RLIKE r'{guards.FLOAT_PATTERN}' AND NOT (coalesce(abs(try_cast(trim(s) AS DOUBLE)) = DOUBLE('inf'), false) "
     "AND NOT contains(lower(s), 'inf')) AND NOT (coalesce(try_cast(trim(s) AS DOUBLE) = 0, false) AND s RLIKE '^[^eE]*[1-9]')"),
    ("is_timestamp", "s STRING", "BOOLEAN",
     f"CASE WHEN s IS NOT NULL THEN try_cast(nullif(regexp_extract(s, r'{guards.TIMESTAMP_PATTERN}', 1), '') AS TIMESTAMP_NTZ) "
     "IS NOT NULL END"),
    ("is_boolean", "s STRING", "BOOLEAN", f"lower(trim(s)) IN ({_words(guards.TRUE_TEXT + guards.FALSE_TEXT)})"),
    ("convert_cpm_to_usvh", "v DOUBLE, u STRING", "DOUBLE",
     "CASE WHEN u IS NOT NULL THEN v / " + _cases({u: units.cpm_divisor(u) for u in units.RADIATION}, "1.0D", lambda d: f"{d}D") + " END"),
    ("calc_combined_mean", "m1 DOUBLE, m2 DOUBLE, n1 BIGINT, n2 BIGINT", "DOUBLE", "(m1 * n1 + m2 * n2) / (n1 + n2)"),
    ("is_array_offline", "a ARRAY<DOUBLE>", "BOOLEAN",
     "CASE WHEN a IS NOT NULL THEN size(a) >= 2 AND try_element_at(a, 1) IS NULL AND try_element_at(a, 2) IS NULL END"),
    ("epsg3857_px_to_lon_z13", "x BIGINT", "DOUBLE", f"(DOUBLE(x) / {packing.PIXELS}D - 0.5D) * 360.0D"),
    ("epsg3857_py_to_lat_z13", "y BIGINT", "DOUBLE",
     f"90.0D - atan(exp((DOUBLE(y) / {packing.PIXELS}D - 0.5D) * {packing.TWO_PI}D)) * 360.0D * {packing.ONE_OVER_PI}D"),
    ("lon_to_epsg3857_px_z13", "lon DOUBLE", "BIGINT",
     f"try_cast(rint((lon + 180.0D) * {packing.PIXELS_PER_DEGREE}D + 0.5D) AS BIGINT)"),
    ("lat_to_epsg3857_py_z13", "lat DOUBLE", "BIGINT",
     f"try_cast(rint((0.5D - ln(try_divide(1.0D + sin(lat * {packing.DEGREES_TO_RADIANS}D), "
     f"1.0D - sin(lat * {packing.DEGREES_TO_RADIANS}D))) * {packing.ONE_OVER_4PI}D) * {packing.PIXELS}D + 0.5D) AS BIGINT)"),
    ("xyt_convert_ts_to_t", "ts TIMESTAMP_NTZ", "BIGINT", "CAST(rint(unix_micros(CAST(ts AS TIMESTAMP)) / 3.6E9D) AS BIGINT)"),
    ("xyt_convert_t_to_ts", "t BIGINT", "TIMESTAMP_NTZ", "CAST(timestamp_seconds(t * 3600) AS TIMESTAMP_NTZ)"),
    ("xyt_convert_t_to_isostring", "t BIGINT", "STRING", "convert_ts_to_isostring(xyt_convert_t_to_ts(t))"),
    ("xyt_convert_ism_to_m", "ism BOOLEAN", "BIGINT", "CASE WHEN ism IS NOT NULL THEN BIGINT(ism) END"),
    ("xyt_encode_x", "x BIGINT", "BIGINT", f"shiftleft(x, {packing.X_SHIFT})"),
    ("xyt_encode_y", "y BIGINT", "BIGINT", f"shiftleft(y, {packing.Y_SHIFT})"),
    ("xyt_encode_m", "m BIGINT", "BIGINT", f"shiftleft(m, {packing.M_SHIFT})"),
    ("xyt_encode_t", "t BIGINT", "BIGINT", "t"),
    ("xyt_encode_xymt", "x BIGINT, y BIGINT, m BIGINT, t BIGINT", "BIGINT",
     "xyt_encode_x(x) | xyt_encode_y(y) | xyt_encode_m(m) | xyt_encode_t(t)"),
    ("xyt_convert_lat_lon_ism_ts_to_xyt", "lat DOUBLE, lon DOUBLE, ism BOOLEAN, ts TIMESTAMP_NTZ", "BIGINT",
     "xyt_encode_xymt(lon_to_epsg3857_px_z13(lon), lat_to_epsg3857_py_z13(lat), xyt_convert_ism_to_m(ism), xyt_convert_ts_to_t(ts))"),
    ("xyt_decode_x", "xyt BIGINT", "BIGINT", f"shiftrightunsigned(xyt, {packing.X_SHIFT})"),
    ("xyt_decode_y", "xyt BIGINT", "BIGINT", f"shiftrightunsigned(xyt, {packing.Y_SHIFT}) & {packing.MASK_21}L"),
    ("xyt_decode_m", "xyt BIGINT", "BIGINT", f"shiftrightunsigned(xyt, {packing.M_SHIFT}) & 1L"),
    ("xyt_decode_t", "xyt BIGINT", "BIGINT", f"xyt & {packing.MASK_21}L"),
    ("xyt_clear_xy", "xyt BIGINT", "BIGINT", f"xyt & {packing.MASK_22}L"),
    ("xyt_clear_xym", "xyt BIGINT", "BIGINT", f"xyt & {packing.MASK_21}L"),
    ("xyt_clear_t", "xyt BIGINT", "BIGINT", f"xyt & {~packing.MASK_21}L"),
    ("xyt_update_encode_xy", "xyt BIGINT, x BIGINT, y BIGINT", "BIGINT",
     "xyt_clear_xy(xyt) | xyt_encode_x(x) | xyt_encode_y(y)"),
    ("xyt_update_encode_t", "xyt BIGINT, t BIGINT", "BIGINT", "xyt_clear_t(xyt) | xyt_encode_t(t)"),
    ("xyt_update_convert_thh_to_tdd", "xyt BIGINT", "BIGINT", "xyt_update_encode_t(xyt, xyt_decode_t(xyt) DIV 24)"),
    ("get_ui_display_unit_parts", "u STRING", units.PARTS_TYPE,
     "CASE WHEN u IS NOT NULL THEN named_struct(" + ", ".join(_part(i, n) for i, n in enumerate(("ch", "si", "mfr", "model"))) + ") END"),
    ("get_ui_display_category", "u STRING", "INT",
     "CASE WHEN u IS NOT NULL THEN "
     + _cases({u: units.category(u) for u in units.UNITS if units.category(u) != units.OTHER_CATEGORY}, str(units.OTHER_CATEGORY)) + " END"),
    ("is_accepted_unit", "u STRING", "BOOLEAN", f"u IN ({_words(units.MAP_UNITS)})"),
    ("is_value_in_range_for_unit", "v DOUBLE, u STRING", "BOOLEAN",
     f"CASE WHEN v IS NOT NULL AND u IS NOT NULL THEN NOT ((u IN ({_words(units.POSITIVE_UNITS)}) AND (v <= 0 OR v > {units.UPPER_LIMIT}D)) "
     f"OR (u IN ({_words(units.NON_NEGATIVE_UNITS)}) AND (v < 0 OR v > {units.UPPER_LIMIT}D))) END"),
]


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
