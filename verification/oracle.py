"""The SQL each registered query must agree with, written independently of the library.

Statements are put together from named common table expressions over the
driver's ``events`` view.
"""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-01-30 20:00:00'"
HOUR = 474068  # 2024-01-30 20:00
DAY = HOUR // 24
DAY_HOUR = 473701  # 2024-01-15 13:20, nearest hour
DAY_FIRST = DAY_HOUR // 24 * 24

FLOAT_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
NUMERIC_RE = r"^\s*([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan)\s*$"
CLOCK_RE = r"^\s*(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?)\s*(Z|[+-]\d{2}(:?\d{2})?)?\s*$"
MAP_UNITS = """lnd_7318 lnd_7318u lnd_7318c lnd_7128 lnd_7128ec lnd_712 lnd_712u lnd_712c lnd_78017 lnd_78017u lnd_78017c
lnd_78017w opc_pm01_0 opc_pm02_5 opc_pm10_0 pms_pm01_0 pms_pm02_5 pms_pm10_0 pms2_pm01_0 pms2_pm02_5 pms2_pm10_0
env_temp env_humid env_press""".split()
STAT_UNITS = MAP_UNITS + "bat_charge bat_current bat_voltage dev_humid dev_press dev_temp loc_lat loc_lon".split()
ALL_UNITS = ["none", *STAT_UNITS, "dev_label", "dev_test"]


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _float(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, '{FLOAT_RE}', 'i') THEN try_cast(trim({s}) AS DOUBLE) END"


def _clock(s: str) -> str:
    return (
        f"CASE WHEN regexp_matches({s}, '{CLOCK_RE}') "
        f"THEN try_cast(regexp_extract({s}, '{CLOCK_RE}', 1) AS TIMESTAMP) END"
    )


def _in_range(v: str, u: str) -> str:
    return (
        f"NOT ((({u} LIKE 'lnd%' OR {u} = 'env_press') AND ({v} <= 0 OR {v} > 1073741824)) "
        f"OR (({u} LIKE 'opc%' OR {u} LIKE 'pms%' OR {u} = 'env_humid') AND ({v} < 0 OR {v} > 1073741824)))"
    )


def _get(k: str) -> str:
    return f"json_extract_string(payload, '$.{k}')"


def _has(k: str) -> str:
    return f"list_contains(json_keys(payload), '{k}')"


def _series(value: str, slots: str) -> str:
    """A list of slot values as text; ``value`` is a list expression over slot ``s``."""
    return (
        f"array_to_string(list_transform({slots}, lambda s: "
        f"coalesce(CAST(CAST(({value}) AS DECIMAL(24,6)) AS VARCHAR), '-')), ',')"
    )


ISO = "'%Y-%m-%dT%H:%M:%SZ'"

DIVISOR = ("CASE WHEN unit LIKE 'lnd_7318%' THEN 334.0::DOUBLE WHEN unit LIKE 'lnd_712%' THEN 120.5::DOUBLE "
           "WHEN unit LIKE 'lnd_78017%' THEN 960.0::DOUBLE ELSE 1.0::DOUBLE END")


def _nearby(movers: str, source: str, radius: int = 26) -> str:
    """Brute force: where each place moves, the places of ``source`` being the targets."""
    best = "{'n': b.n, 'x': -b.x, 'y': -b.y}"
    return f"""SELECT a.x, a.y, arg_max(b.x, {best}) AS to_x, arg_max(b.y, {best}) AS to_y FROM ({movers}) a
      JOIN (SELECT x, y, sum(n) AS n FROM {source} GROUP BY x, y) b
      ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {radius * radius} GROUP BY a.x, a.y"""


CTES = {
    "m": f"""SELECT event_id AS id, user_id AS device_id, ts AS created_at, ts AS updated_at, '{{"device":' || user_id ||
      CASE WHEN event_id % 50 = 6 THEN '' ELSE ',"loc_lat":' || CASE event_id % 50 WHEN 3 THEN '95.5' WHEN 7 THEN '0.5'
        WHEN 8 THEN '"n/a"' ELSE CAST(CAST(((user_id % 7) * 20 - 55) + 0.125 AS DECIMAL(9,3)) AS VARCHAR) END END ||
      ',"loc_lon":' || CASE WHEN event_id % 50 = 7 THEN '-0.5'
        ELSE CAST(CAST(((user_id % 7) * 50 - 150) + 0.25 AS DECIMAL(9,3)) AS VARCHAR) END ||
      CASE event_id % 50 WHEN 4 THEN ',"when_captured":null' WHEN 5 THEN ',"when_captured":"1998-19-250T04:35:59Z"'
        WHEN 9 THEN '' ELSE ',"when_captured":"' || strftime(ts, {ISO}) || '"' END ||
      CASE event_id % 50 WHEN 0 THEN ',"dev_test":true' WHEN 10 THEN ',"dev_test":false' WHEN 11 THEN ',"dev_test":null'
        WHEN 1 THEN ',"loc_motion":false' ELSE '' END ||
      CASE WHEN event_id % 10 = 2 THEN ',"dev_label":"unit-' || user_id || '-' || event_id % 3 || '"' ELSE '' END ||
      ',"' || CASE event_type WHEN 'click' THEN 'lnd_7318u' WHEN 'view' THEN 'lnd_7128ec' WHEN 'error' THEN 'opc_pm02_5'
        WHEN 'purchase' THEN 'env_temp' ELSE 'bat_voltage' END || '":' ||
      CASE event_id % 50 WHEN 2 THEN '"abc"' WHEN 12 THEN '-1' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END ||
      '}}' AS payload FROM events""",
    "kv": """SELECT *, json_extract_string(payload, '$."' || k || '"') AS txt
      FROM (SELECT *, unnest(json_keys(payload)) AS k FROM m)""",
    "marked": f"""SELECT *, coalesce(lat BETWEEN -85.05 AND 85.05 AND lon BETWEEN -180 AND 180
        AND NOT (lat BETWEEN -1 AND 1 AND lon BETWEEN -1 AND 1), FALSE) AS place_ok,
        (NOT has_captured OR coalesce(captured BETWEEN TIMESTAMP '2011-03-11' AND {NOW} + INTERVAL 48 HOUR, FALSE)) AS time_ok,
        coalesce(captured, created_at) AS event_time
      FROM (SELECT *, {_float(_get('loc_lat'))} AS lat, {_float(_get('loc_lon'))} AS lon,
        {_has('loc_lat')} AND {_has('loc_lon')} AS has_place, {_has('when_captured')} AS has_captured,
        {_clock(_get('when_captured'))} AS captured,
        CASE WHEN {_has('loc_motion')} THEN TRUE WHEN NOT {_has('dev_test')} THEN FALSE
             WHEN {_get('dev_test')} = 'false' THEN FALSE ELSE TRUE END AS motion FROM m)""",
    "located": """SELECT *, CAST(round_even((lon + 180.0::DOUBLE) * 5825.422222222222::DOUBLE + 0.5::DOUBLE, 0) AS BIGINT) AS x,
        CAST(round_even((0.5::DOUBLE - ln((1 + sin(lat * 0.0174532925199433::DOUBLE)) / (1 - sin(lat * 0.0174532925199433::DOUBLE)))
          * 0.0795774715459477::DOUBLE) * 2097152.0::DOUBLE + 0.5::DOUBLE, 0) AS BIGINT) AS y,
        CAST(motion AS BIGINT) AS m,
        CAST(round_even(epoch_us(event_time) / 3600000000.0::DOUBLE, 0) AS BIGINT) AS t
      FROM marked WHERE place_ok""",
    "keyed": """SELECT *, CAST(CASE WHEN big >= 9223372036854775808 THEN big - 18446744073709551616 ELSE big END AS BIGINT) AS xyt
      FROM (SELECT *, (x % 2097152)::HUGEINT * 8796093022208 + y * 4194304 + m * 2097152 + t AS big FROM located)""",
    "readings": f"""SELECT * FROM (SELECT q.id, q.device_id, k AS unit, {_float('txt')} AS value, x, y, m, t, xyt, event_time, q.created_at
        FROM keyed q JOIN (SELECT id, k, txt FROM kv) e ON e.id = q.id WHERE time_ok AND k IN {_in(MAP_UNITS)})
      WHERE value IS NOT NULL AND {_in_range('value', 'unit')}""",
    "hh": "SELECT xyt, any_value(x) AS x, any_value(y) AS y, any_value(m) AS m, any_value(t) AS t, unit AS u, "
          "avg(value) AS v, count(*) AS n FROM readings GROUP BY xyt, unit",
    "dd": """SELECT xyt - t + t // 24 AS xyt, any_value(x) AS x, any_value(y) AS y, any_value(m) AS m, t // 24 AS t, u,
      sum(v * n) / sum(n) AS v, CAST(sum(n) AS BIGINT) AS n FROM hh GROUP BY xyt - t + t // 24, t // 24, u""",
    "divisor": f"SELECT unnest({ALL_UNITS}) AS u",
    "hh24": f"SELECT * REPLACE (v / d AS v) FROM hhu WHERE t > {HOUR} - 24 AND m = 0",
    "hh24_any": f"SELECT * REPLACE (v / d AS v) FROM hhu WHERE t > {HOUR} - 24",
    "hh_still": "SELECT * REPLACE (v / d AS v) FROM hhu WHERE m = 0",
    "hh_day": f"SELECT * REPLACE (v / d AS v) FROM hhu WHERE t BETWEEN {DAY_FIRST} AND {DAY_FIRST + 23} AND m = 0",
    "hh_day_before": f"SELECT * REPLACE (v / d AS v) FROM hhu WHERE t BETWEEN {DAY_FIRST - 24} AND {DAY_FIRST - 1} AND m = 0",
    "dd30": f"SELECT * REPLACE (v / d AS v) FROM ddu WHERE t > {DAY} - 30 AND m = 0",
    "dd30_any": f"SELECT * REPLACE (v / d AS v) FROM ddu WHERE t > {DAY} - 30",
    "dd_still": "SELECT * REPLACE (v / d AS v) FROM ddu WHERE m = 0",
    "hhu": "SELECT *, CASE WHEN u LIKE 'lnd_7318%' THEN 334.0::DOUBLE WHEN u LIKE 'lnd_712%' THEN 120.5::DOUBLE "
           "WHEN u LIKE 'lnd_78017%' THEN 960.0::DOUBLE ELSE 1.0::DOUBLE END AS d FROM hh",
    "ddu": "SELECT *, CASE WHEN u LIKE 'lnd_7318%' THEN 334.0::DOUBLE WHEN u LIKE 'lnd_712%' THEN 120.5::DOUBLE "
           "WHEN u LIKE 'lnd_78017%' THEN 960.0::DOUBLE ELSE 1.0::DOUBLE END AS d FROM dd",
    "jittered": "SELECT * REPLACE (x + id % 61 AS x, y + id % 47 AS y) FROM readings",
    "jhh": f"SELECT x, y, m, t, unit AS u, avg(value) / any_value({DIVISOR}) AS v, count(*) AS n FROM jittered GROUP BY x, y, m, t, unit",
    "jhh24": f"SELECT * FROM jhh WHERE t > {HOUR} - 24 AND m = 0",
    "jday": f"SELECT * FROM jhh WHERE t BETWEEN {DAY_FIRST} AND {DAY_FIRST + 23} AND m = 0",
    "jdd30": f"""SELECT x, y, m, t // 24 AS t, u, sum(v * n) / sum(n) AS v, sum(n) AS n FROM jhh
      WHERE t // 24 > {DAY} - 30 AND m = 0 GROUP BY x, y, m, t // 24, u""",
    "moves24": _nearby("SELECT x, y FROM jhh24 UNION SELECT x, y FROM jdd30", "jhh24"),
    "moves_day": _nearby("SELECT DISTINCT x, y FROM jday", "jday"),
    **{name: f"""SELECT to_x AS x, to_y AS y, m, t, u, sum(v * n) / sum(n) AS v, sum(n) AS n FROM {rows} JOIN {moves} USING (x, y)
      GROUP BY to_x, to_y, m, t, u""" for name, rows, moves in (
        ("shh24", "jhh24", "moves24"), ("sdd30", "jdd30", "moves24"), ("sday", "jday", "moves_day"))},
    **{name: f"SELECT to_x AS x, to_y AS y, m, t, device_id FROM jittered JOIN {moves} USING (x, y)" for name, moves in (
        ("seen24", "moves24"), ("seen_day", "moves_day"))},
    "stat_kv": f"""SELECT * FROM (SELECT id, device_id, created_at, k AS unit, {_float('txt')} AS value FROM kv
      WHERE k IN {_in(STAT_UNITS)}) WHERE value IS NOT NULL AND {_in_range('value', 'unit')}""",
    "mid": "SELECT max(event_id) // 2 AS mid FROM events",
    "svc": f"""SELECT event_id AS id, ts, user_id AS device,
      CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'urn:shared'
           WHEN event_id % 11 = 0 THEN 'urn:unit:' || user_id % 10 ELSE 'urn:unit:' || user_id END AS device_urn,
      CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 3 = 0 THEN 'sn-' || user_id % 4 ELSE 'sn-' || user_id END AS device_sn,
      CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 25 = 1 THEN '1998-19-250T04:35:59Z' ELSE strftime(ts, {ISO}) END AS when_captured,
      CASE WHEN event_id % 8 = 0 THEN NULL ELSE strftime(ts + INTERVAL 90 SECOND, {ISO}) END AS service_uploaded,
      CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST((user_id % 7) * 20 - 55 AS VARCHAR) END AS lat,
      CASE WHEN event_id % 30 = 7 THEN 'east' ELSE CAST((user_id % 7) * 50 - 150 AS VARCHAR) END AS lon,
      event_id % 2 = 0 AS dev_test, event_id AS pms, CAST(value AS DECIMAL(18,2)) AS env_temp,
      CASE WHEN event_id % 40 = 9 THEN repeat('n', 1100) ELSE 'place ' || user_id % 7 END AS loc_name, event_type AS x_note FROM events""",
    "svc_time": f"SELECT *, coalesce(when_captured, service_uploaded, strftime({NOW}, {ISO})) AS document_time FROM svc",
    "top": "SELECT device, count(*) AS n FROM svc GROUP BY device ORDER BY n DESC, device LIMIT 1000",
    "long": "SELECT device, 'device_sn' AS field, device_sn AS term FROM svc UNION ALL SELECT device, 'device_urn', device_urn FROM svc",
    "scored": """SELECT *, (fg - bg) * fg / bg AS score FROM (
      SELECT c.device, c.field, c.term, c.n, c.n / dt.n AS fg, b.n / (SELECT count(*) FROM svc) AS bg
      FROM (SELECT device, field, term, count(*) AS n FROM long WHERE term IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) c
      JOIN (SELECT field, term, count(*) AS n FROM long WHERE term IS NOT NULL GROUP BY ALL) b ON b.field = c.field AND b.term = c.term
      JOIN (SELECT device, count(*) AS n FROM svc GROUP BY device) dt ON dt.device = c.device) WHERE fg > bg""",
    "best": """SELECT device, field, term FROM (SELECT *, row_number() OVER (PARTITION BY device, field ORDER BY score DESC, n DESC, term) AS rn
      FROM scored) WHERE rn = 1""",
    "details": """SELECT top.device, max(term) FILTER (field = 'device_sn') AS device_sn, max(term) FILTER (field = 'device_urn') AS device_urn
      FROM (SELECT DISTINCT device FROM svc) top LEFT JOIN best ON best.device = top.device GROUP BY top.device""",
    "devices": """SELECT user_id, min(ts) AS created_at, max(ts) AS updated_at, md5('device-' || user_id) AS h FROM events GROUP BY user_id""",
    "device_rows": """SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id,
      CAST((user_id % 360) - 180 + 0.25 AS DOUBLE) AS longitude, CAST((user_id % 170) - 85 + 0.5 AS DOUBLE) AS latitude,
      'Place ' || user_id % 7 AS location_name, '{"numeric_id":' || user_id || '}' AS payload, created_at, updated_at FROM devices""",
    "posts": """SELECT event_id AS id, CASE event_id % 20
      WHEN 0 THEN '{"device_id":' || user_id || ',"lndp_cpm":' || event_id % 97 || '}'
      WHEN 1 THEN '{"device":' || user_id || ',"device_urn":"urn:unit:' || user_id || '"}'
      WHEN 2 THEN '{"device_id":"' || user_id || '","device_urn":' || event_id || '}'
      WHEN 3 THEN '{"lora_snr":7,"lndp_cpm":25}'
      WHEN 4 THEN '{"device_id":"unit-' || user_id || '"}'
      WHEN 5 THEN '{"device":' || user_id || '.5}'
      WHEN 6 THEN '{"device_id":null,"device":' || user_id || '}'
      WHEN 7 THEN '{"device_id":' || user_id
      WHEN 8 THEN '[' || user_id || ']'
      WHEN 9 THEN '{"device_id":' || user_id || ',"device":"x"}'
      WHEN 10 THEN '{"device_id":' || user_id || '} garbage'
      WHEN 11 THEN '{''device_id'':' || user_id || '}'
      WHEN 12 THEN '{"device_id":' || user_id || ',"v":NaN}'
      WHEN 13 THEN '{"device_id":' || user_id || '}{"device_id":' || user_id + 1 || '}'
      ELSE '{"device_id":' || user_id || ',"device":' || user_id + 1 || ',"lndc_cpm":' || CAST(value AS DECIMAL(18,2)) || '}' END AS payload
      FROM events""",
    "judged": r"""SELECT *, CASE WHEN NOT ok THEN 'malformed'
        WHEN (a IS NOT NULL AND NOT regexp_matches(a, '^\s*[+-]?\d+\s*$')) OR (b IS NOT NULL AND NOT regexp_matches(b, '^\s*[+-]?\d+\s*$')) THEN 'bad_type'
        WHEN coalesce(a, b) IS NULL THEN 'missing_device' END AS reject_reason
      FROM (SELECT *, CASE WHEN ok THEN json_extract_string(payload, '$.device_id') END AS a,
                      CASE WHEN ok THEN json_extract_string(payload, '$.device') END AS b,
                      CASE WHEN ok THEN json_extract_string(payload, '$.device_urn') END AS device_urn
        FROM (SELECT *, json_valid(payload) AND payload[1:1] = '{' AND NOT contains(payload, ':NaN') AS ok FROM posts))""",
    "legacy": f"""SELECT event_id AS id, user_id AS device_id, ts AS created_at,
      CASE WHEN event_id % 11 IN (3, 4) THEN NULL ELSE (user_id % 170) - 85 + 0.5 END AS latitude,
      CASE WHEN event_id % 13 = 5 THEN NULL ELSE (user_id % 360) - 180 + 0.25 END AS longitude,
      CASE WHEN event_id % 17 = 6 THEN NULL WHEN event_id % 2 = 0 THEN date_trunc('second', ts)
           ELSE date_trunc('second', ts) - INTERVAL 9 HOUR END AS captured_at FROM events""",
    "places": """SELECT 1000000 + (user_id % 40) * 31 + event_id % 23 AS x,
      CAST(700000 + (user_id % 8) * 37 + CAST(floor(value) AS BIGINT) % 19 AS BIGINT) AS y, count(*) AS n FROM events GROUP BY 1, 2""",
    "halves": "SELECT r.*, device_id <= (SELECT max(user_id) // 2 FROM events) AS early FROM readings r",
    "state": "SELECT xyt, unit AS u, avg(value) AS v, count(*) AS n FROM halves WHERE early GROUP BY xyt, unit",
    "delta": "SELECT xyt, unit AS u, avg(value) AS v, count(*) AS n FROM halves WHERE NOT early GROUP BY xyt, unit",
    "sent": "SELECT id, device_id, created_at AS ts, k AS unit, txt AS val FROM kv WHERE k IN ('dev_label', 'dev_test') AND txt IS NOT NULL",
    "ordinals": "SELECT u AS unit, row_number() OVER () AS ordinal FROM (SELECT unnest(" + str(ALL_UNITS) + ") AS u)",
    "stats": """SELECT device_id, unit, min(value) AS v_min, max(value) AS v_max, arg_max(value, {'t': created_at, 'i': id}) AS v_val,
      count(*) AS n, min(created_at) AS min_ts, max(created_at) AS max_ts FROM stat_kv GROUP BY device_id, unit""",
    "meta": f"""SELECT device_id, unit, arg_max(val, {{'t': ts, 'i': id}}) AS val, max(ts) AS ts FROM sent GROUP BY device_id, unit
      UNION ALL SELECT DISTINCT device_id, 'dev_test', 'false', {NOW} FROM m
      WHERE device_id NOT IN (SELECT device_id FROM sent WHERE unit = 'dev_test')""",
}


def _reach(start: str) -> list[str]:
    """The expressions a statement needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(start)
    return order


def sql(body: str) -> str:
    names = _reach(body)
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + body


def _slot_series(source: str, anchor: int, slots: str) -> str:
    """x, y, u and the list of slots ``vs``; a moving bin beats a still one in the same slot."""
    return f"""SELECT x, y, u, list_transform({slots}, lambda s: mv[s]) AS vs FROM (
      SELECT x, y, u, map_from_entries(list((off, v))) AS mv FROM (
        SELECT x, y, u, t - {anchor} AS off, arg_max(v, m) AS v FROM {source} GROUP BY x, y, u, t - {anchor}) GROUP BY x, y, u)"""


H24 = "range(-23, 1)"
D30 = "range(-29, 1)"
D24 = "range(0, 24)"


def _text(vs: str) -> str:
    return f"array_to_string(list_transform({vs}, lambda q: coalesce(CAST(CAST(q AS DECIMAL(24,6)) AS VARCHAR), '-')), ',')"


SI = "CASE WHEN u LIKE 'lnd%' THEN 'μSv/h' WHEN u LIKE 'opc%' OR u LIKE 'pms%' THEN 'μg/m³' WHEN u = 'env_temp' THEN '°C' WHEN u = 'env_humid' THEN 'RH%' WHEN u = 'env_press' THEN 'hPa' END"
MODEL = "CASE WHEN u LIKE 'lnd%' THEN regexp_extract(u, 'lnd_(\\d+)', 1) WHEN u LIKE 'opc%' THEN 'OPC-N2' WHEN u LIKE 'pms2%' THEN 'PMS5003 (2)' WHEN u LIKE 'pms%' THEN 'PMS5003' END"
CATEGORY = ("CASE WHEN u IN ('lnd_7318u', 'opc_pm01_0', 'opc_pm02_5', 'opc_pm10_0') THEN 1 WHEN u LIKE 'pms\\_%' ESCAPE '\\' THEN 2 "
            "WHEN u LIKE 'pms2%' THEN 3 WHEN u IN ('lnd_7318c', 'lnd_7128ec', 'env_temp', 'env_humid', 'env_press') THEN 4 ELSE 5 END")
LAT = "round(90 - 360 * atan(exp(-(0.5::DOUBLE - y / 2097152.0::DOUBLE) * 6.283185307179586::DOUBLE)) * 0.3183098861837907::DOUBLE, 6)"
LON = "round(360 * (x / 2097152.0::DOUBLE - 0.5::DOUBLE), 6)"


def _device_lists(condition: str, source: str = "readings") -> str:
    return (f"SELECT x, y, array_to_string(list_sort(list(DISTINCT device_id)), ',') AS device_ids "
            f"FROM {source} WHERE {condition} GROUP BY x, y")


def _summary(vs: str) -> str:
    return (f"{_text(vs)} AS series, round(list_min({vs}), 6) AS v_min, round(list_max({vs}), 6) AS v_max")


def _newest(vs: str) -> str:
    return (f"round(list_filter({vs}, lambda q: q IS NOT NULL)[-1], 6) AS v_value_newest, "
            f"CASE WHEN {vs} IS NOT NULL THEN {vs}[1] IS NULL AND {vs}[2] IS NULL END AS is_offline")


def _map_sql(hours: str, days: str, devices: str, source: str = "readings") -> str:
    def part(vs, first, last, seconds, start):
        return (f"SELECT x, y, u, strftime(make_timestamp({start}::BIGINT * 1000000), {ISO}) AS start_date, "
                f"strftime({NOW}, {ISO}) AS end_date, CAST({first} AS BIGINT) AS start_epoch_timepart, "
                f"CAST({last} AS BIGINT) AS end_epoch_timepart, {seconds} AS ss_per_epoch_timepart, "
                f"CASE WHEN {vs} IS NULL THEN '' ELSE {_text(vs)} END AS series, round(list_min({vs}), 6) AS v_min, "
                f"round(list_max({vs}), 6) AS v_max, {_newest(vs)} FROM both_series")
    return f"""SELECT {LAT} AS lat, {LON} AS lon, coalesce(device_ids, '') AS device_ids, u AS unit, {SI} AS si, {MODEL} AS model,
        {CATEGORY} AS category, s.* EXCLUDE (x, y, u) FROM (
        WITH hour_series AS ({_slot_series(hours, HOUR, H24)}), day_series AS ({_slot_series(days, DAY, D30)}),
        both_series AS (SELECT h.x, h.y, h.u, h.vs AS vs_h, d.vs AS vs_d FROM hour_series h
          LEFT JOIN day_series d ON d.x = h.x AND d.y = h.y AND d.u = h.u)
        {part('vs_d', DAY - 29, DAY, 86400, (DAY - 29) * 86400)} UNION ALL {part('vs_h', HOUR - 23, HOUR, 3600, (HOUR - 23) * 3600)}) s
      LEFT JOIN ({_device_lists(devices, source)}) l USING (x, y)"""


def _daily_sql(anchor: int, hours: str = "hh_day", source: str = "readings", first: int | None = None) -> str:
    first = DAY_FIRST if first is None else first
    last = first + 23
    return f"""SELECT {LAT} AS lat, {LON} AS lon, device_ids, u AS unit, {SI} AS si, {MODEL} AS model,
        strftime(make_timestamp({first * 3600}::BIGINT * 1000000), {ISO}) AS start_date,
        strftime(make_timestamp({last * 3600 - 1}::BIGINT * 1000000), {ISO}) AS end_date, CAST({first} AS BIGINT) AS start_epoch_timepart,
        CAST({last} AS BIGINT) AS end_epoch_timepart, 3600 AS ss_per_epoch_timepart, {_summary('vs')}
      FROM ({_slot_series(hours, anchor, D24)}) s
      LEFT JOIN ({_device_lists(f't BETWEEN {first} AND {last} AND m = 0', source)}) l USING (x, y)"""


def _snapped(places: str, radius: int) -> str:
    """Brute force: every place against every other."""
    return f"""SELECT a.x, a.y, arg_max(b.x, {{'n': b.n, 'x': -b.x, 'y': -b.y}}) AS to_x, arg_max(b.y, {{'n': b.n, 'x': -b.x, 'y': -b.y}}) AS to_y
      FROM {places} a JOIN {places} b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {radius * radius}
      GROUP BY a.x, a.y"""


DOCUMENT_ROW = f"""id, {_clock('document_time')} AS timestamp, {_clock('when_captured')} AS when_captured,
  {_clock('service_uploaded')} AS service_uploaded, device, device_sn, device_urn, dev_test, pms AS pms_c00_30,
  round(CAST(CAST(env_temp AS FLOAT) AS DOUBLE), 3) AS env_temp, loc_name,
  CASE WHEN length(loc_name) > 1024 THEN 'loc_name' ELSE '' END AS ignored, CAST(NULL AS FLOAT) AS bat_charge,
  try_cast(lat AS DOUBLE) AS loc_lat, try_cast(lon AS DOUBLE) AS loc_lon,
  CASE WHEN try_cast(lon AS DOUBLE) IS NOT NULL THEN try_cast(lat AS DOUBLE) END AS lat,
  CASE WHEN lat IS NOT NULL THEN try_cast(lon AS DOUBLE) END AS lon, x_note, CAST(1 AS BIGINT) AS n_extra"""
MESSAGE_LENGTH = "length('{\"version\":1,\"payload\":') + 1"
V6 = "xyt, u, round(v, 6) AS v, n"

# Text of a service payload, for the length totals of the archive.
SERVICE_TEXT = f"""'{{"device":' || user_id ||
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN ',"device_urn":"urn:shared"'
       WHEN event_id % 11 = 0 THEN ',"device_urn":"urn:unit:' || user_id % 10 || '"' ELSE ',"device_urn":"urn:unit:' || user_id || '"' END ||
  CASE WHEN event_type = 'signup' THEN ',"device_sn":null' WHEN event_id % 3 = 0 THEN ',"device_sn":"sn-' || user_id % 4 || '"'
       ELSE ',"device_sn":"sn-' || user_id || '"' END ||
  CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"when_captured":"' || CASE WHEN event_id % 25 = 1 THEN '1998-19-250T04:35:59Z'
       ELSE strftime(ts, {ISO}) END || '"' END ||
  CASE WHEN event_id % 8 = 0 THEN '' ELSE ',"service_uploaded":"' || strftime(ts + INTERVAL 90 SECOND, {ISO}) || '"' END ||
  CASE WHEN event_id % 6 = 0 THEN '' ELSE ',"loc_lat":' || ((user_id % 7) * 20 - 55) END ||
  ',"loc_lon":' || CASE WHEN event_id % 30 = 7 THEN '"east"' ELSE CAST((user_id % 7) * 50 - 150 AS VARCHAR) END ||
  ',"dev_test":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ||
  ',"pms_c00_30":' || event_id || ',"env_temp":' || CAST(value AS DECIMAL(18,2)) ||
  ',"loc_name":"' || CASE WHEN event_id % 40 = 9 THEN repeat('n', 1100) ELSE 'place ' || user_id % 7 END || '"' ||
  ',"x_note":"' || event_type || '"}}'"""
ARCHIVE = f"""SELECT '2024-01-30' AS date, 20 AS hour, 0 AS minute, count(*) AS n,
  CAST(sum({MESSAGE_LENGTH} + length({SERVICE_TEXT})) AS BIGINT) AS n_chars FROM events"""

BODIES = {
    "intake_accept": "SELECT id, CAST(coalesce(a, b) AS BIGINT) AS device_id, device_urn, payload FROM judged WHERE reject_reason IS NULL",
    "intake_reject_counts": "SELECT reject_reason, count(*) AS n FROM judged WHERE reject_reason IS NOT NULL GROUP BY reject_reason",
    "publish_envelope": """SELECT '{"version":1,"payload":' || payload || '}' AS value FROM judged WHERE reject_reason IS NULL""",
    "jsonl_load": f"""SELECT device_id, 'true' AS dev_test, count(*) AS n,
      CAST(sum(len(json_keys(payload)) + CASE WHEN {_has('dev_test')} THEN 0 ELSE 1 END) AS BIGINT) AS n_keys FROM m GROUP BY device_id""",
    "measurement_projection": "SELECT id, device_id, payload FROM m",
    "mappable_view": """SELECT id, created_at, device_id, captured_at, CAST(latitude AS DOUBLE) AS x, CAST(longitude AS DOUBLE) AS y
      FROM legacy WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND captured_at IS NOT NULL""",
    "device_list": "SELECT * FROM device_rows",
    "device_lookup": "SELECT * FROM device_rows ORDER BY created_at, id LIMIT 1",
    "payload_unpivot": f"""SELECT id, device_id, k AS key, CASE WHEN num IS NULL THEN txt END AS text, round(num, 6) AS number
      FROM (SELECT *, {_float('txt')} AS num FROM kv)""",
    "typecheck_counts": f"""SELECT k AS key, count(*) AS n, count_if(regexp_matches(txt, '{FLOAT_RE}', 'i')) AS n_float,
      count_if(regexp_matches(txt, '{NUMERIC_RE}', 'i')) AS n_numeric, count_if({_clock('txt')} IS NOT NULL) AS n_timestamp,
      count_if(lower(trim(txt)) IN {_in('t tr tru true y ye yes on 1 f fa fal fals false n no of off 0'.split())}) AS n_boolean,
      count_if(regexp_matches(txt, '^\\s*[+-]?nan\\s*$', 'i')) AS n_nan, count_if(txt IS NULL) AS n_null FROM kv GROUP BY k""",
    "reject_breakdown": f"""SELECT reason, count(*) AS n, count(DISTINCT device_id) AS n_devices FROM (
      SELECT q.id, q.device_id, CASE WHEN NOT has_place THEN 'no_place' WHEN lat IS NULL OR lon IS NULL THEN 'place_not_numeric'
        WHEN NOT place_ok THEN 'place_out_of_range' WHEN NOT time_ok THEN 'when_captured' WHEN n_units IS NULL THEN 'no_map_unit'
        WHEN n_num = 0 THEN 'value_not_numeric' WHEN n_ok = 0 THEN 'value_out_of_range' ELSE 'accepted' END AS reason
      FROM marked q LEFT JOIN (SELECT id, count(*) AS n_units, count(val) AS n_num, count_if(val IS NOT NULL AND {_in_range('val', 'k')}) AS n_ok
        FROM (SELECT id, k, {_float('txt')} AS val FROM kv WHERE k IN {_in(MAP_UNITS)}) GROUP BY id) e ON e.id = q.id) GROUP BY reason""",
    "motion_flag_counts": "SELECT device_id, motion, count(*) AS n FROM marked GROUP BY device_id, motion",
    "explode_readings": "SELECT id AS original_id, device_id, unit, round(value, 6) AS value, xyt, event_time FROM readings",
    "rekey_xyt": "SELECT id, x, y, m, t, xyt FROM keyed",
    "decode_xyt": f"""SELECT DISTINCT xyt, x, y, m, t, m * 2097152 + t AS no_xy, t AS no_xym, xyt - t AS no_t,
      CAST(CASE WHEN sw >= 9223372036854775808 THEN sw - 18446744073709551616 ELSE sw END AS BIGINT) AS swapped, xyt + 1 AS next_hour,
      xyt - t + t // 24 AS day_key, {LON} AS lon, {LAT} AS lat, strftime(make_timestamp(t * 3600000000), {ISO}) AS hour_text,
      round(sqrt(x * x + y * y), 4) AS distance, x || '_' || y || '_any' AS place
      FROM (SELECT *, y::HUGEINT * 8796093022208 + x * 4194304 + m * 2097152 + t AS sw FROM readings)""",
    "unit_conversion": "SELECT id AS original_id, unit, round(value / CASE WHEN unit LIKE 'lnd_7318%' THEN 334.0::DOUBLE "
                       "WHEN unit LIKE 'lnd_712%' THEN 120.5::DOUBLE WHEN unit LIKE 'lnd_78017%' THEN 960.0::DOUBLE ELSE 1.0::DOUBLE END, 6) "
                       "AS converted FROM readings",
    "units_dim": f"""SELECT unit, ordinal, unit IN {_in(MAP_UNITS)} AS map_unit, unit IN {_in(STAT_UNITS)} AS stat_unit,
      CASE WHEN limited THEN 0.0::DOUBLE END AS lo, coalesce(unit LIKE 'opc%' OR unit LIKE 'pms%' OR unit = 'env_humid', FALSE) AS lo_included,
      CASE WHEN limited THEN 1073741824.0::DOUBLE END AS hi,
      CASE WHEN unit LIKE 'lnd_7318%' THEN 334.0::DOUBLE WHEN unit LIKE 'lnd_712%' THEN 120.5::DOUBLE
           WHEN unit LIKE 'lnd_78017%' THEN 960.0::DOUBLE ELSE 1.0::DOUBLE END AS cpm_divisor,
      CASE WHEN unit IN ('lnd_712c', 'lnd_7318c', 'lnd_78017c', 'lnd_78017w') THEN '(γ)' WHEN unit LIKE '%pm01_0' THEN 'PM 1.0'
           WHEN unit LIKE '%pm02_5' THEN 'PM 2.5' WHEN unit LIKE '%pm10_0' THEN 'PM 10.0' END AS ch, {SI} AS si,
      CASE WHEN unit LIKE 'lnd%' THEN 'LND' WHEN unit LIKE 'opc%' THEN 'Alphasense' WHEN unit LIKE 'pms%' THEN 'Plantower' END AS mfr,
      {MODEL} AS model, {CATEGORY} AS category, coalesce(n, 0) AS n, round(mx, 6) AS max_value
      FROM (SELECT o.*, o.unit AS u, c.n, c.mx, o.unit LIKE 'lnd%' OR o.unit LIKE 'opc%' OR o.unit LIKE 'pms%' OR o.unit IN ('env_press', 'env_humid') AS limited
        FROM ordinals o LEFT JOIN (SELECT unit, count(*) AS n, max(value) AS mx FROM stat_kv GROUP BY unit) c ON c.unit = o.unit)""",
    "bad_date_cleanup": "SELECT id, when_captured FROM svc WHERE when_captured IS NULL OR CAST(split_part(when_captured, '-', 2) AS INT) <= 12",
    "hourly_bins": f"SELECT {V6} FROM hh",
    "daily_rollup": f"SELECT {V6} FROM dd",
    "window_24h": f"SELECT {V6} FROM hh WHERE t > {HOUR} - 24",
    "window_30d": f"SELECT {V6} FROM dd WHERE t > {DAY} - 30",
    "window_day": f"SELECT {V6} FROM hh WHERE t BETWEEN {DAY_FIRST} AND {DAY_FIRST + 23} AND m = 0",
    "location_density": "SELECT x, y, CAST(sum(n) AS BIGINT) AS n FROM hh GROUP BY x, y",
    "bin_devices": "SELECT DISTINCT xyt, device_id FROM readings WHERE xyt IN (SELECT xyt FROM hh24)",
    "location_devices": _device_lists("TRUE"),
    "daily_bins_in_view": f"SELECT {V6} FROM dd30 WHERE (x, y) IN (SELECT (x, y) FROM hh24)",
    "snap_r0": "SELECT x, y, x AS to_x, y AS to_y FROM places",
    "snap_r26": _snapped("places", 26),
    "reaggregate_snapped": f"""SELECT CAST(CASE WHEN big >= 9223372036854775808 THEN big - 18446744073709551616 ELSE big END AS BIGINT) AS xyt, u,
      round(v, 6) AS v, n FROM (SELECT to_x::HUGEINT * 8796093022208 + to_y * 4194304 + t AS big, u, sum(v * n) / sum(n) AS v,
        CAST(sum(n) AS BIGINT) AS n FROM hh JOIN (WITH spots AS (SELECT x, y, sum(n) AS n FROM hh WHERE m = 0 GROUP BY x, y)
          {_snapped('spots', 600_000)}) s ON s.x = hh.x AND s.y = hh.y WHERE m = 0 GROUP BY 1, 2)""",
    "merge_hourly": f"SELECT {V6} FROM hh",
    "merge_daily": f"SELECT {V6} FROM dd",
    "merge_new_bins": "SELECT d.xyt, d.u, round(d.v, 6) AS v, d.n, s.xyt IS NULL AS is_new FROM delta d LEFT JOIN state s ON s.xyt = d.xyt AND s.u = d.u",
    "combined_mean": """SELECT s.xyt, s.u, round(s.v * (s.n / (s.n + d.n)) + d.v * (d.n / (s.n + d.n)), 6) AS v, s.n + d.n AS n
      FROM state s JOIN delta d ON s.xyt = d.xyt AND s.u = d.u""",
    "merge_touch": f"""SELECT h.xyt, h.u, round(h.v, 6) AS v, h.n,
      CASE WHEN d.xyt IS NULL THEN TIMESTAMP '2024-01-30 18:00:00' ELSE {NOW} END AS updated_at
      FROM hh h LEFT JOIN delta d ON d.xyt = h.xyt AND d.u = h.u""",
    "incremental_candidates": """SELECT id, device_id, created_at FROM m
      WHERE id > coalesce((SELECT max(id) FROM readings WHERE id <= (SELECT mid FROM mid)), 0)""",
    "incremental_gaps": "SELECT id, device_id, created_at FROM m WHERE id > (SELECT mid FROM mid) OR id % 97 = 5",
    "incremental_by_ts": """SELECT id, device_id, created_at FROM m
      WHERE created_at > (SELECT max(created_at) FROM stat_kv WHERE id <= (SELECT mid FROM mid))""",
    "accepted_candidates": "SELECT DISTINCT id AS original_id, xyt, unit FROM readings",
    "series_24h": f"SELECT x, y, u, {_text('vs')} AS series FROM ({_slot_series('hh24', HOUR, H24)})",
    "series_30d": f"SELECT x, y, u, {_text('vs')} AS series FROM ({_slot_series('dd30', DAY, D30)})",
    "series_day": f"SELECT x, y, u, {_text('vs')} AS series FROM ({_slot_series('hh_day', DAY_HOUR, D24)})",
    "series_devtest": f"SELECT x, y, u, {_text('vs')} AS series FROM ({_slot_series('hh24_any', HOUR, H24)})",
    "series_summary": f"""SELECT x, y, u, round(list_min(vs), 6) AS v_min, round(list_max(vs), 6) AS v_max,
      round(list_filter(vs, lambda q: q IS NOT NULL)[-1], 6) AS v_newest, vs[1] IS NULL AND vs[2] IS NULL AS offline_oldest,
      vs[24] IS NULL AND vs[23] IS NULL AS offline_latest, {_text('list_reverse(vs)')} AS reversed
      FROM ({_slot_series('hh24', HOUR, H24)})""",
    "pivot_cells": """SELECT device_id, string_agg(unit || '=' || n, ',' ORDER BY unit) AS cells
      FROM (SELECT device_id, unit, count(*) AS n FROM readings GROUP BY device_id, unit) GROUP BY device_id""",
    "map_two_days": f"{_daily_sql(DAY_HOUR - 24, 'hh_day_before', 'readings', DAY_FIRST - 24)} UNION ALL {_daily_sql(DAY_HOUR)}",
    "dynamic_pivot": "SELECT device_id, " + ", ".join(
        f"nullif(count(*) FILTER (unit = '{u}'), 0) AS {u}" for u in ("env_temp", "lnd_7128ec", "lnd_7318u", "opc_pm02_5")
    ) + " FROM readings GROUP BY device_id",
    "map_24h": _map_sql("hh24", "dd30", f"t > {HOUR} - 24 AND m = 0"),
    "map_24h_devtest": _map_sql("hh24_any", "dd30_any", f"t > {HOUR} - 24"),
    "map_24h_all_dates": _map_sql("hh_still", "dd_still", "m = 0"),
    "stream_map_24h": _map_sql("hh24", "dd30", f"t > {HOUR} - 24 AND m = 0"),
    "map_24h_r26": _map_sql("shh24", "sdd30", f"t > {HOUR} - 24 AND m = 0", "seen24"),
    "map_daily_r26": _daily_sql(DAY_HOUR, "sday", "seen_day"),
    "map_daily": _daily_sql(DAY_HOUR),
    "map_daily_from_start": _daily_sql(DAY_FIRST),
    "device_stats": "SELECT device_id, unit, round(v_min, 6) AS v_min, round(v_max, 6) AS v_max, round(v_val, 6) AS v_val, n, min_ts, max_ts FROM stats",
    "merge_device_stats": """SELECT device_id, unit, round(min(value), 6) AS v_min, round(max(value), 6) AS v_max,
      round(coalesce(arg_max(value, {'t': created_at, 'i': id}) FILTER (id > (SELECT mid FROM mid)), arg_max(value, {'t': created_at, 'i': id})), 6) AS v_val,
      count(*) AS n, min(created_at) AS min_ts, max(created_at) AS max_ts FROM stat_kv GROUP BY device_id, unit""",
    "device_meta": "SELECT device_id, unit, val, ts FROM meta",
    "dev_test_cleared": f"""SELECT DISTINCT device_id, 'dev_test' AS unit, 'false' AS val, {NOW} AS ts, 'second' AS load FROM m
      WHERE id > (SELECT mid FROM mid) AND device_id NOT IN
        (SELECT device_id FROM sent WHERE unit = 'dev_test' AND id > (SELECT mid FROM mid))
      UNION ALL SELECT DISTINCT device_id, 'dev_test', 'false', TIMESTAMP '2024-01-30 18:00:00', 'first' FROM m
      WHERE id <= (SELECT mid FROM mid) AND device_id NOT IN
        (SELECT device_id FROM sent WHERE unit = 'dev_test' AND id <= (SELECT mid FROM mid))""",
    "merge_device_meta": f"""SELECT coalesce(b.device_id, a.device_id) AS device_id, coalesce(b.unit, a.unit) AS unit,
      CASE WHEN b.unit IS NOT NULL THEN b.val ELSE a.val END AS val, CASE WHEN b.unit IS NOT NULL THEN b.ts ELSE a.ts END AS ts FROM (
        SELECT device_id, unit, arg_max(val, {{'t': ts, 'i': id}}) AS val, max(ts) AS ts FROM sent WHERE id <= (SELECT mid FROM mid) GROUP BY 1, 2
        UNION ALL SELECT DISTINCT device_id, 'dev_test', 'false', TIMESTAMP '2024-01-30 18:00:00' FROM m WHERE id <= (SELECT mid FROM mid)
          AND device_id NOT IN (SELECT device_id FROM sent WHERE unit = 'dev_test' AND id <= (SELECT mid FROM mid))) a
      FULL JOIN (SELECT device_id, unit, arg_max(val, {{'t': ts, 'i': id}}) AS val, max(ts) AS ts FROM sent WHERE id > (SELECT mid FROM mid) GROUP BY 1, 2
        UNION ALL SELECT DISTINCT device_id, 'dev_test', 'false', {NOW} FROM m WHERE id > (SELECT mid FROM mid)
          AND device_id NOT IN (SELECT device_id FROM sent WHERE unit = 'dev_test' AND id > (SELECT mid FROM mid))) b
      ON b.device_id = a.device_id AND b.unit = a.unit""",
    "device_stats_report": f"""SELECT s.device_id, l.val AS dev_label, e.val AS dev_test,
      CAST(row_number() OVER (PARTITION BY s.device_id ORDER BY ordinal) - 1 AS INT) AS pos, s.unit, round(v_min, 6) AS v_min,
      round(v_max, 6) AS v_max, round(v_val, 6) AS v_val, n, strftime(min_ts, {ISO}) AS min_ts, strftime(max_ts, {ISO}) AS max_ts
      FROM stats s JOIN ordinals o ON o.unit = s.unit
      LEFT JOIN (SELECT * FROM meta WHERE unit = 'dev_label') l ON l.device_id = s.device_id
      LEFT JOIN (SELECT * FROM meta WHERE unit = 'dev_test') e ON e.device_id = s.device_id""",
    "top_devices": "SELECT device, n FROM top",
    "device_details": "SELECT device, device_sn, device_urn FROM details",
    "backfill_device_details": """SELECT s.id, s.device, coalesce(s.device_sn, d.device_sn) AS device_sn,
      coalesce(s.device_urn, d.device_urn) AS device_urn FROM svc s LEFT JOIN details d ON d.device = s.device""",
    "doc_enrich": "SELECT id, document_time, CASE WHEN lat IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon, "
                  "'2024-01-30' AS index_date FROM svc_time",
    "doc_typed_projection": f"SELECT {DOCUMENT_ROW} FROM svc_time",
    "doc_rewrite": f"SELECT {DOCUMENT_ROW} FROM svc_time",
    "csv_dump": "SELECT id, device_id, payload, created_at, updated_at FROM m",
    "monthly_report_counts": """SELECT strftime(up, '%Y-%m-01') AS month, count(*) AS n, min(id) AS min_id, max(id) AS max_id
      FROM (SELECT event_id AS id, ts + INTERVAL 90 SECOND - to_days(CAST(event_id % 45 AS INT)) AS up FROM events)
      WHERE up >= TIMESTAMP '2023-12-01' AND up < TIMESTAMP '2024-02-01' GROUP BY 1""",
    "yearly_compaction_counts": """SELECT CAST(year(d) AS INT) AS year, device, count(*) AS n, max(id) AS max_id
      FROM (SELECT event_id AS id, user_id AS device, CAST(ts AS DATE) - CAST(user_id % 60 AS INT) AS d FROM events) GROUP BY 1, 2""",
    "retention_remaining": """SELECT CAST(d AS VARCHAR) AS index_date, count(*) AS n
      FROM (SELECT CAST(ts AS DATE) - CAST(user_id % 60 AS INT) AS d FROM events) WHERE year(d) <> 2023 GROUP BY d""",
    "raw_archive_index": ARCHIVE,
    "stream_archive": ARCHIVE,
    "stream_hourly_state": f"SELECT {V6} FROM hh",
    "stream_daily_state": f"SELECT {V6} FROM dd",
    "stream_windowed_hours": f"SELECT {V6} FROM hh",
    "stream_documents": f"""SELECT '2024-01-30' AS index_date, device, count(*) AS n, count({_clock('when_captured')}) AS n_dated,
      count(CASE WHEN try_cast(lon AS DOUBLE) IS NOT NULL THEN lat END) AS n_placed FROM svc GROUP BY device""",
}

BODIES["stream_map_daily"] = BODIES["map_daily"]
BODIES["stream_device_stats"] = BODIES["device_stats"]
BODIES["stream_device_texts"] = BODIES["merge_device_meta"].replace("TIMESTAMP '2024-01-30 18:00:00'", NOW)
BODIES["stream_device_report"] = BODIES["device_stats_report"].replace("FROM meta", f"FROM ({BODIES['merge_device_meta']})")
for _name in ("map_24h", "map_daily", "device_stats_report"):
    BODIES[f"{_name}_written"] = BODIES[_name]
BODIES["sql_functions"] = BODIES["decode_xyt"]
BODIES["sql_rekey"] = BODIES["rekey_xyt"]

SQL = {name: sql(body) for name, body in BODIES.items()}
