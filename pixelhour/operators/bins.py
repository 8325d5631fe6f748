"""Hour and day bins: mergeable aggregates per packed key and unit.

Bins carry ``sum_v`` and ``n``, which add up in any order; the mean ``v`` is
derived. Every aggregation here is algebraic, so Spark combines map-side before
the shuffle and a hot place costs one row per task, not one per reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelhour.functions import packing, units

KEY = ["xyt", "u"]
HOURS_PER_DAY = 24


def with_mean(bins: DataFrame) -> DataFrame:
    return bins.withColumn("v", F.col("sum_v") / F.col("n"))


def hourly_bins(readings: DataFrame) -> DataFrame:
    """xyt, u, sum_v, n, v from readings."""
    grouped = readings.groupBy("xyt", F.col("unit").alias("u")).agg(
        F.sum("value").alias("sum_v"), F.count(F.lit(1)).alias("n")
    )
    return with_mean(grouped)


def device_bins(readings: DataFrame) -> DataFrame:
    """Hour bins kept apart by device: xyt, u, device_id, sum_v, n.

    One pass over the readings yields everything the reports need: regrouped
    they are the hour bins, and their keys are the key/device pairs.
    """
    return readings.groupBy("xyt", F.col("unit").alias("u"), "device_id").agg(
        F.sum("value").alias("sum_v"), F.count(F.lit(1)).alias("n")
    )


def regroup(bins: DataFrame) -> DataFrame:
    """Add up bins of equal key: after merging states, re-keying or snapping."""
    return with_mean(bins.groupBy(*KEY).agg(F.sum("sum_v").alias("sum_v"), F.sum("n").alias("n")))


def daily_rollup(hourly: DataFrame) -> DataFrame:
    """Hour bins re-keyed to days and added up: the sample-weighted mean per day."""
    return regroup(hourly.withColumn("xyt", packing.hour_key_to_day_key(F.col("xyt"))))


def merge(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Existing bins take the delta's samples; unknown bins are added."""
    columns = [*KEY, "sum_v", "n"]
    return regroup(state.select(*columns).unionByName(delta.select(*columns)))


def split_delta(state: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The delta's bins already in the state, and those new to it.

    Only keys of the state are read, so its scan prunes to two columns.
    """
    known = state.select(*KEY)
    return delta.join(known, KEY, "left_semi"), delta.join(known, KEY, "left_anti")


def only_still(bins: DataFrame, apply: bool = True) -> DataFrame:
    """Without bins flagged as moving or under test."""
    return bins.filter(packing.decode_m(F.col("xyt")) == 0) if apply else bins


def last_24_hours(bins: DataFrame, hour: int, apply: bool = True) -> DataFrame:
    """Hour bins newer than 24 hours before the reference hour; no upper end."""
    return bins.filter(packing.decode_t(F.col("xyt")) > hour - HOURS_PER_DAY) if apply else bins


def last_30_days(bins: DataFrame, hour: int, apply: bool = True) -> DataFrame:
    return bins.filter(packing.decode_t(F.col("xyt")) > hour // HOURS_PER_DAY - 30) if apply else bins


def calendar_day(bins: DataFrame, hour: int) -> DataFrame:
    """Hour bins of the day that contains the reference hour."""
    start = hour // HOURS_PER_DAY * HOURS_PER_DAY
    return bins.filter(packing.decode_t(F.col("xyt")).between(start, start + HOURS_PER_DAY - 1))


def in_display_units(bins: DataFrame) -> DataFrame:
    """Radiation counts as dose rate. The factor is constant per unit, so sums scale like means."""
    return with_mean(bins.withColumn("sum_v", units.to_usvh(F.col("sum_v"), F.col("u"))))


def unpack(bins: DataFrame) -> DataFrame:
    """Add x, y, m, t."""
    return bins.select("*", *packing.unpacked(F.col("xyt")))


def density(bins: DataFrame) -> DataFrame:
    """Samples per place: x, y, n."""
    return (
        bins.groupBy(packing.decode_x(F.col("xyt")).alias("x"), packing.decode_y(F.col("xyt")).alias("y"))
        .agg(F.sum("n").alias("n"))
    )


def at_places(bins: DataFrame, places: DataFrame) -> DataFrame:
    """Bins whose place is among the given ones."""
    keyed = bins.withColumn("x", packing.decode_x(F.col("xyt"))).withColumn("y", packing.decode_y(F.col("xyt")))
    return keyed.join(places.select("x", "y"), ["x", "y"], "left_semi").select(*bins.columns)


def devices_of_bins(readings: DataFrame, bins: DataFrame) -> DataFrame:
    """xyt, device_id of the readings behind the given bins, each pair once.

    Readings carry the device, so the lookup back to measurements falls away.
    Pairs are made distinct before the join to keep the shuffle small.
    """
    pairs = readings.select("xyt", "device_id").distinct()
    return pairs.join(bins.select("xyt"), "xyt", "left_semi")


def device_words(pairs: DataFrame) -> DataFrame:
    """x, y, word, bits: the devices of each place as a set of bits, 64 neighbouring ids in a row, from xyt/device pairs.

    A set is merged by :func:`merge_words`. Building one is a hash aggregation of
    long numbers, combined before its shuffle, so a place seen by very many devices
    costs a row for each 64 of them and no list.
    """
    device = F.col("device_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), device.bitwiseAND(F.lit(63)).cast("int"))
    return merge_words(pairs.filter(device.isNotNull()).select(
        packing.decode_x(F.col("xyt")).alias("x"), packing.decode_y(F.col("xyt")).alias("y"),
        F.shiftright(device.cast("long"), 6).alias("word"), bit.alias("bits"),
    ))


def merge_words(words: DataFrame) -> DataFrame:
    """Sets of several sources as one."""
    return words.groupBy("x", "y", "word").agg(F.bit_or("bits").alias("bits"))


def _ids(word: Column, bits: Column) -> Column:
    """The ids of a word's set bits, ascending."""
    places = F.filter(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1)) == 1,
    )
    return F.transform(places, lambda i: F.shiftleft(word, 6) + i)


def devices_of_words(words: DataFrame) -> DataFrame:
    """x, y, device_id: a row for each device of a place."""
    return words.select("x", "y", F.explode(_ids(F.col("word"), F.col("bits"))).alias("device_id"))


def devices_of_places(pairs: DataFrame) -> DataFrame:
    """x, y, device_ids (distinct, ascending) from xyt/device pairs, for the document of a place.

    Words of bits are gathered, and opened when the place is complete.
    """
    gathered = device_words(pairs).groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    ids = F.flatten(F.transform("words", lambda w: _ids(w["word"], w["bits"])))
    return gathered.select("x", "y", ids.alias("device_ids"))


def epoch_day(xyt: Column) -> Column:
    """Partition value for hour bins and readings."""
    return packing.day_of_hour(packing.decode_t(xyt)).cast("int")
