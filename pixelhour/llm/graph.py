"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.llm.common import Scratch


def _renamed(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The edges between the parents of their ends, once each, without loops.

    Both sides of each join are saved tables that are shuffled for it alone, so
    adaptive execution splits a node that has very many edges over tasks.
    """
    for end in ("a", "b"):
        side = parents.select(F.col("node").alias(end), F.col("parent").alias(f"parent_{end}"))
        edges = edges.join(side.hint("merge"), end)
    return edges.select(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is its smallest reachable node.

    Each round takes for every node the first of itself and its neighbours as its
    parent, a minimum by key that is combined before the shuffle, and goes on with
    the edges between parents, until none is left. The first round goes by id,
    which ends stars around their smallest node at once; later ones go by a hash
    of the round, under which a node whose neighbours are all behind it keeps its
    place and the others go, so that long chains shrink by a constant factor a
    round too. At the end the parents are followed from the last round to the
    first. Edges of a round are saved and deleted after the next. Loops, repeated
    edges and null ends are left out; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    now = scratch.save(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        if rounds:
            turn = F.lit(len(rounds))
            first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("v"))).alias("other"))
            mine = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("v"))
            parents = first.select(F.col("a").alias("node"), F.least(mine, F.col("other"))["v"].alias("parent"))
        else:
            parents = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        rounds.append(scratch.save(parents))
        now = scratch.save(_renamed(now, rounds[-1]))
        scratch.drop(now, *rounds)
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = rounds[-1].withColumnRenamed("parent", "component")
    for parents in reversed(rounds[:-1]):
        up = label.select(F.col("node").alias("parent"), "component")
        label = parents.join(up.hint("merge"), "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    if len(rounds) > 1:  # hashed rounds end at some node of a component
        label = scratch.save(label)
        least = scratch.save(label.groupBy("component").agg(F.min("node").alias("least")))
        label = label.join(least, "component").select("node", F.col("least").alias("component"))
    found = scratch.save(label)
    scratch.drop(found)
    return found
