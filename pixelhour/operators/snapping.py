"""Move places onto the busiest place nearby."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelhour.functions import packing
from pixelhour.session import written


def _rank(prefix: str = ""):
    """Ordering of candidates: most samples, then smallest x, then smallest y.

    x and y have 21 bits each, so they fit one BIGINT together; with ``n`` in
    front as a decimal the whole ordering is one number and ``max`` stays a hash
    aggregation.
    """
    n, x, y = (F.col(prefix + c) for c in ("n", "x", "y"))
    place = F.shiftleft(F.lit(packing.MASK_21) - x, 21).bitwiseOR(F.lit(packing.MASK_21) - y)
    return (n.cast("decimal(19,0)") * F.lit(1 << 42).cast("decimal(13,0)")).cast("decimal(34,0)") + place


def _place_of(rank) -> list:
    place = (rank % F.lit(1 << 42).cast("decimal(13,0)")).cast("bigint")
    return [
        (F.lit(packing.MASK_21) - F.shiftright(place, 21)).alias("to_x"),
        (F.lit(packing.MASK_21) - place.bitwiseAND(F.lit(packing.MASK_21))).alias("to_y"),
    ]


#: Cells of one level hold 4 x 4 cells of the next finer one.
STEP = 2


def _meets_disk(level: int, radius: int) -> Column:
    """Whether a pixel of the cell (cx, cy) lies closer than ``radius`` to (x, y)."""
    side = 1 << level

    def gap(place: str, cell: str) -> Column:
        low = F.col(cell) * side
        return F.greatest(F.lit(0).cast("long"), low - F.col(place), F.col(place) - (low + (side - 1)))

    dx, dy = gap("x", "cx"), gap("y", "cy")
    return dx * dx + dy * dy < radius * radius


def _cells(frontier: DataFrame, first: Column, second: Column, offsets: range, level: int, radius: int) -> DataFrame:
    """The frontier's rows with every cell at ``first + i, second + j`` that the disk meets."""
    steps = F.array(*[F.struct((first + i).alias("cx"), (second + j).alias("cy")) for i in offsets for j in offsets])
    return frontier.select("x", "y", "best", F.inline(steps)).filter(_meets_disk(level, radius))


def targets(places: DataFrame, radius: int = 0, others: DataFrame | None = None) -> DataFrame:
    """x, y → to_x, to_y: the place with the most samples closer than ``radius`` pixels.

    ``others`` (x, y) are places that move to one of ``places`` but are no target
    themselves; one without a target nearby has no row. Radius 0 is the identity.

    Cells of halving size form a pyramid, each with the best place in it. From the
    coarsest level, a place looks at the best of the few cells around it: one that
    does not outrank what is known is done with, one that lies inside the disk is
    the new best of its cell, and only a cell whose best lies outside, while a part
    of it lies inside, is opened into the finer cells that the disk meets. So a
    place opens cells along the rim of its disk only, whatever the number of places
    in them, and the best of a cell is one row. Ends when no cell is left to open.
    """
    if radius <= 0:
        return places.select("x", "y", F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    whole = [F.col(c).cast("long").alias(c) for c in ("x", "y")]
    # Read once for each level; places are few next to the readings they come from.
    ranked = written(places.select(*whole, _rank().cast("decimal(38,0)").alias("rank")), "places")
    movers = ranked.select("x", "y", F.col("rank").alias("best"))
    if others is not None:
        unranked = others.select(*whole, F.lit(None).cast("decimal(38,0)").alias("best"))
        movers = written(movers.union(unranked).groupBy("x", "y").agg(F.max("best").alias("best")), "movers")
    level = STEP * -(-(radius - 1).bit_length() // STEP)
    at_level = lambda c, k: F.shiftright(F.col(c), k)
    frontier = _cells(movers, at_level("x", level), at_level("y", level), range(-1, 2), level, radius)
    found = [movers]
    while True:
        cells = ranked.groupBy(at_level("x", level).alias("cx"), at_level("y", level).alias("cy")).agg(F.max("rank").alias("rank"))
        to_x, to_y = _place_of(F.col("rank"))
        dx, dy = F.col("x") - to_x, F.col("y") - to_y
        met = frontier.join(cells, ["cx", "cy"]).filter(F.col("best").isNull() | (F.col("rank") > F.col("best")))
        met = met.withColumn("inside", dx * dx + dy * dy < radius * radius)
        nearer = F.max(F.when(F.col("inside"), F.col("rank"))).over(Window.partitionBy("x", "y"))
        met = written(met.withColumn("best", F.greatest("best", nearer)), "cells")
        found.append(met.select("x", "y", "best"))
        frontier = met.filter(~F.col("inside") & (F.col("best").isNull() | (F.col("rank") > F.col("best"))))
        if level == 0 or frontier.isEmpty():
            break
        level -= STEP
        frontier = _cells(
            frontier, F.shiftleft(F.col("cx"), STEP), F.shiftleft(F.col("cy"), STEP), range(1 << STEP), level, radius,
        )
    best = reduce(DataFrame.union, found).groupBy("x", "y").agg(F.max("best").alias("best"))
    return best.filter("best is not null").select("x", "y", *_place_of(F.col("best")))


def snap_bins(bins: DataFrame, moves: DataFrame) -> DataFrame:
    """Re-key bins to their targets; bins of a place without target are dropped.

    Re-keyed bins may share a key: add them up with ``bins.regroup``.
    """
    rest = [c for c in bins.columns if c != "xyt"]
    keyed = bins.withColumn("x", packing.decode_x(F.col("xyt"))).withColumn("y", packing.decode_y(F.col("xyt")))
    moved = packing.with_xy(F.col("xyt"), F.col("to_x"), F.col("to_y"))
    return keyed.join(moves, ["x", "y"]).select(moved.alias("xyt"), *rest)
