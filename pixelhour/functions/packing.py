"""The packed place/motion/time key and the map projection behind it.

One BIGINT holds, from the high end, pixel x (21 bits), pixel y (21 bits), a
motion flag (1 bit) and an hour or day number (21 bits). Joins and groupings
use it as a single narrow key.

Conversions from fractions round half to even (``rint``): hour bins are centred
on the full hour, and a longitude of +180 wraps around to pixel 0. Coordinates
without a pixel (NaN, the poles) give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout and projection constants.
X_SHIFT = 43
Y_SHIFT = 22
M_SHIFT = 21
MASK_21 = 0x1FFFFF
MASK_22 = 0x3FFFFF
PIXELS = 2097152.0
PIXELS_PER_DEGREE = 5825.422222222222
DEGREES_TO_RADIANS = 0.0174532925199433
ONE_OVER_4PI = 0.0795774715459477
TWO_PI = 6.283185307179586476925286766559
ONE_OVER_PI = 0.31830988618379067153776752674503


def lon_to_px(lon: Column) -> Column:
    return F.rint((lon + 180.0) * PIXELS_PER_DEGREE + 0.5).try_cast("bigint")


def lat_to_py(lat: Column) -> Column:
    sine = F.sin(lat * DEGREES_TO_RADIANS)
    stretched = F.log(F.try_divide(1.0 + sine, 1.0 - sine)) * ONE_OVER_4PI
    return F.rint((0.5 - stretched) * PIXELS + 0.5).try_cast("bigint")


def px_to_lon(x: Column) -> Column:
    return (x.cast("double") / PIXELS - 0.5) * 360.0


def py_to_lat(y: Column) -> Column:
    angle = F.atan(F.exp((y.cast("double") / PIXELS - 0.5) * TWO_PI))
    return 90.0 - angle * 360.0 * ONE_OVER_PI


def epoch_micros(clock: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ or of a TIMESTAMP (session zone UTC)."""
    return F.unix_micros(clock.cast("timestamp"))


def hour_number(clock: Column) -> Column:
    return F.rint(epoch_micros(clock) / 3.6e9).cast("bigint")


def hour_to_clock(t: Column) -> Column:
    return F.timestamp_seconds(t * 3600).cast("timestamp_ntz")


def day_of_hour(t: Column) -> Column:
    """Whole days of a non-negative hour number."""
    return F.floor(t / 24)


def motion_bit(flag: Column) -> Column:
    return F.when(flag, 1).when(~flag, 0).cast("bigint")


def encode_x(x: Column) -> Column:
    return F.shiftleft(x, X_SHIFT)


def encode_y(y: Column) -> Column:
    return F.shiftleft(y, Y_SHIFT)


def encode_m(m: Column) -> Column:
    return F.shiftleft(m, M_SHIFT)


def pack(x: Column, y: Column, m: Column, t: Column) -> Column:
    return encode_x(x).bitwiseOR(encode_y(y)).bitwiseOR(encode_m(m)).bitwiseOR(t)


def pack_place_and_clock(lat: Column, lon: Column, motion: Column, clock: Column) -> Column:
    return pack(lon_to_px(lon), lat_to_py(lat), motion_bit(motion), hour_number(clock))


def decode_x(xyt: Column) -> Column:
    return F.shiftrightunsigned(xyt, X_SHIFT)


def decode_y(xyt: Column) -> Column:
    return F.shiftrightunsigned(xyt, Y_SHIFT).bitwiseAND(F.lit(MASK_21))


def decode_m(xyt: Column) -> Column:
    return F.shiftrightunsigned(xyt, M_SHIFT).bitwiseAND(F.lit(1))


def decode_t(xyt: Column) -> Column:
    return xyt.bitwiseAND(F.lit(MASK_21))


def clear_xy(xyt: Column) -> Column:
    return xyt.bitwiseAND(F.lit(MASK_22))


def clear_xym(xyt: Column) -> Column:
    return decode_t(xyt)


def clear_t(xyt: Column) -> Column:
    return xyt.bitwiseAND(F.lit(~MASK_21))


def with_xy(xyt: Column, x: Column, y: Column) -> Column:
    return clear_xy(xyt).bitwiseOR(encode_x(x)).bitwiseOR(encode_y(y))


def with_t(xyt: Column, t: Column) -> Column:
    return clear_t(xyt).bitwiseOR(t)


def hour_key_to_day_key(xyt: Column) -> Column:
    return with_t(xyt, day_of_hour(decode_t(xyt)))


def unpacked(xyt: Column) -> list[Column]:
    """The four parts as columns x, y, m, t."""
    return [
        decode_x(xyt).alias("x"),
        decode_y(xyt).alias("y"),
        decode_m(xyt).alias("m"),
        decode_t(xyt).alias("t"),
    ]
