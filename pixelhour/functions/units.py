"""The measurement units: which are accepted where, their limits and display data.

The catalogue is fixed and has 35 entries, so rules over it are literal lists
inside expressions; nothing is joined or broadcast for them.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit names in declaration order, which is also their sort order.
UNITS = [
    "none",
    "lnd_7318", "lnd_7318u", "lnd_7318c",
    "lnd_7128", "lnd_7128ec",
    "lnd_712", "lnd_712u", "lnd_712c",
    "lnd_78017", "lnd_78017u", "lnd_78017c", "lnd_78017w",
    "opc_pm01_0", "opc_pm02_5", "opc_pm10_0",
    "pms_pm01_0", "pms_pm02_5", "pms_pm10_0",
    "pms2_pm01_0", "pms2_pm02_5", "pms2_pm10_0",
    "env_temp", "env_humid", "env_press",
    "bat_charge", "bat_current", "bat_voltage",
    "dev_humid", "dev_press", "dev_temp",
    "loc_lat", "loc_lon",
    "dev_label", "dev_test",
]
RADIATION = [u for u in UNITS if u.startswith("lnd_")]
PARTICLES = [u for u in UNITS if u.startswith(("opc_", "pms_", "pms2_"))]
ENVIRONMENT = ["env_temp", "env_humid", "env_press"]
MAP_UNITS = RADIATION + PARTICLES + ENVIRONMENT
STAT_UNITS = [u for u in UNITS if u not in ("none", "dev_label", "dev_test")]
TEXT_UNITS = ["dev_label", "dev_test"]

UPPER_LIMIT = float(1 << 30)
POSITIVE_UNITS = RADIATION + ["env_press"]
NON_NEGATIVE_UNITS = PARTICLES + ["env_humid"]

# Counts per minute for one microsievert per hour, by tube.
CPM_PER_USVH = {"lnd_7318": 334.0, "lnd_7128": 120.5, "lnd_712": 120.5, "lnd_78017": 960.0}
# Display data.
MAKER_AND_MODEL = {
    "opc": ("Alphasense", "OPC-N2"),
    "pms": ("Plantower", "PMS5003"),
    "pms2": ("Plantower", "PMS5003 (2)"),
}
CHANNELS = {"pm01_0": "PM 1.0", "pm02_5": "PM 2.5", "pm10_0": "PM 10.0"}
GAMMA_UNITS = ["lnd_712c", "lnd_7318c", "lnd_78017c", "lnd_78017w"]
SI_NAMES = {"env_temp": "°C", "env_humid": "RH%", "env_press": "hPa"}
CATEGORIES = {
    1: ["lnd_7318u", "opc_pm01_0", "opc_pm02_5", "opc_pm10_0"],
    2: ["pms_pm01_0", "pms_pm02_5", "pms_pm10_0"],
    3: ["pms2_pm01_0", "pms2_pm02_5", "pms2_pm10_0"],
    4: ["lnd_7318c", "lnd_7128ec", "env_temp", "env_humid", "env_press"],
}
OTHER_CATEGORY = 5

PARTS_TYPE = "struct<ch:string,si:string,mfr:string,model:string>"


def tube_of(unit: str) -> str | None:
    """The tube a radiation unit belongs to: its name without the channel letters."""
    return unit.rstrip("abcdefghijklmnopqrstuvwxyz") if unit in RADIATION else None


def cpm_divisor(unit: str) -> float:
    return CPM_PER_USVH.get(tube_of(unit), 1.0)


def category(unit: str) -> int:
    return next((c for c, members in CATEGORIES.items() if unit in members), OTHER_CATEGORY)


def display_parts(unit: str) -> tuple[str | None, str | None, str | None, str | None]:
    """(channel, SI name, maker, model)."""
    family, _, rest = unit.partition("_")
    if unit in PARTICLES:
        return (CHANNELS[rest], "μg/m³", *MAKER_AND_MODEL[family])
    if unit in RADIATION:
        return ("(γ)" if unit in GAMMA_UNITS else None, "μSv/h", "LND", tube_of(unit)[4:])
    return (None, SI_NAMES.get(unit), None, None)


def _by_unit(unit: Column, values: dict[str, object], otherwise: object, type_: str) -> Column:
    """A lookup as one comparison per distinct value rather than per unit."""
    groups = defaultdict(list)
    for name, value in values.items():
        if value != otherwise:
            groups[value].append(name)
    out = F
    for value, names in groups.items():
        out = out.when(unit.isin(names), F.lit(value).cast(type_))
    return out.otherwise(F.lit(otherwise).cast(type_))


def is_map_unit(unit: Column) -> Column:
    return unit.isin(MAP_UNITS)


def is_stat_unit(unit: Column) -> Column:
    return unit.isin(STAT_UNITS)


def in_range(value: Column, unit: Column) -> Column:
    """False outside the unit's limits. Units without limits pass whatever the value, NaN included."""
    too_high = value > UPPER_LIMIT
    return F.when(value.isNotNull() & unit.isNotNull(), ~(
        (unit.isin(POSITIVE_UNITS) & ((value <= 0.0) | too_high))
        | (unit.isin(NON_NEGATIVE_UNITS) & ((value < 0.0) | too_high))
    ))


def to_usvh(value: Column, unit: Column) -> Column:
    """Counts per minute to microsievert per hour; other units unchanged."""
    return F.when(unit.isNotNull(), value / _by_unit(unit, {u: cpm_divisor(u) for u in UNITS}, 1.0, "double"))


def ordinal_of(unit: Column) -> Column:
    """Position in declaration order, from 1."""
    return F.array_position(F.array(*[F.lit(u) for u in UNITS]), unit)


def category_of(unit: Column) -> Column:
    return F.when(unit.isNotNull(), _by_unit(unit, {u: category(u) for u in UNITS}, OTHER_CATEGORY, "int"))


def parts_of(unit: Column) -> Column:
    fields = []
    for i, name in enumerate(("ch", "si", "mfr", "model")):
        fields.append(_by_unit(unit, {u: display_parts(u)[i] for u in UNITS}, None, "string").alias(name))
    return F.when(unit.isNotNull(), F.struct(*fields))


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    rows = [
        (
            u, i, u in MAP_UNITS, u in STAT_UNITS,
            0.0 if u in POSITIVE_UNITS + NON_NEGATIVE_UNITS else None,
            u in NON_NEGATIVE_UNITS,
            UPPER_LIMIT if u in POSITIVE_UNITS + NON_NEGATIVE_UNITS else None,
            cpm_divisor(u), *display_parts(u), category(u),
        )
        for i, u in enumerate(UNITS, start=1)
    ]
    schema = T.StructType([
        T.StructField("unit", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("map_unit", T.BooleanType(), False),
        T.StructField("stat_unit", T.BooleanType(), False),
        T.StructField("lo", T.DoubleType()),
        T.StructField("lo_included", T.BooleanType(), False),
        T.StructField("hi", T.DoubleType()),
        T.StructField("cpm_divisor", T.DoubleType(), False),
        T.StructField("ch", T.StringType()),
        T.StructField("si", T.StringType()),
        T.StructField("mfr", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("category", T.IntegerType(), False),
    ])
    return spark.createDataFrame(rows, schema)
