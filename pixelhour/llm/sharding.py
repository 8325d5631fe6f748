"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws an
exponential arrival time, hashed from the row's id and the child's name and
divided by the child's weight, and the earliest wins: children win in proportion
to weight, and changing one child's weight only moves rows into or out of that
child. A node's weight is stated, not summed, so a change stays inside the
subtrees whose weights change. Built-in functions, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelhour.llm.common import documents, text_or_empty

SEED = 20240131
#: Slots are numbered in so many pieces of each shard, so that no task needs a whole shard.
PIECES = 1024
BROADCAST_PIECES = 200_000


@dataclass(frozen=True)
class Tree:
    """``children[node]`` has (name, weight) pairs; the root is ``""``; a shard's name is its number."""

    children: dict[str, tuple[tuple[str, float], ...]]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> Tree:
        """Equal shards of weight 1, numbered from 0 in order."""
        children: dict[str, tuple[tuple[str, float], ...]] = {"": tuple((f"r{i}", float(racks * shards)) for i in range(regions))}
        for i in range(regions):
            children[f"r{i}"] = tuple((f"r{i}.{j}", float(shards)) for j in range(racks))
            for j in range(racks):
                first = (i * racks + j) * shards
                children[f"r{i}.{j}"] = tuple((str(first + k), 1.0) for k in range(shards))
        return Tree(children)

    def shards(self) -> list[int]:
        return sorted(int(name) for kids in self.children.values() for name, _ in kids if name not in self.children)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own: rows move only into it."""
        n = max(self.shards(), default=-1) + 1
        region, rack = f"r+{n}", f"r+{n}.0"
        return Tree({**self.children, "": (*self.children[""], (region, weight)), region: ((rack, weight),), rack: ((str(n), weight),)})

    def reweighted(self, name: str, weight: float) -> Tree:
        """Another weight for one node. Its siblings' rows move only into or out of it."""
        return Tree({p: tuple((n, weight if n == name else w) for n, w in kids) for p, kids in self.children.items()})


def shard_of(key: Column, tree: Tree, seed: int = SEED, levels: int = 3) -> Column:
    """The shard of a key. A null key is a key like any other; a child of weight 0 wins nothing."""
    def arrival(name: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, name), 11).cast("double")
        return -F.log((draw + 0.5) * 2.0**-53)

    entries = [
        part for parent, kids in tree.children.items()
        for part in (F.lit(parent), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in kids if w > 0]))
    ]
    table, node = F.create_map(*entries), F.lit("")
    for _ in range(levels):
        draws = F.transform(table[node], lambda c: F.struct((arrival(c["name"]) / c["weight"]).alias("at"), c["name"].alias("name")))
        node = F.array_min(draws)["name"]
    return node.cast("int")


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id", into: str = "shard", seed: int = SEED) -> DataFrame:
    """Every row with its shard; a column named ``into`` is replaced."""
    return docs.withColumn(into, shard_of(F.col(key), tree, seed))


def number_slots(placed: DataFrame, shards: int, pieces: int = PIECES) -> DataFrame:
    """Every row with ``slot``: 0, 1, 2 … within its ``shard``.

    Rows are counted by hashed pieces of a shard, the pieces' first slots summed
    up over those counts, and rows numbered within their piece. Equal rows are
    counted first and told apart last, so repeats cannot fill one task.
    """
    columns = [c for c in placed.columns if c not in ("slot", "shard")]
    rows = placed.withColumn("_piece", F.pmod(F.xxhash64(*columns), F.lit(pieces)).cast("int"))
    first = rows.groupBy("shard", "_piece").count().withColumn(
        "_first", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("count")
    first = F.broadcast(first) if shards * pieces <= BROADCAST_PIECES else first
    counted = rows.groupBy("shard", "_piece", *columns).agg(F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy("shard", "_piece").orderBy(*columns)
    counted = counted.withColumn("_upto", F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        counted.join(first, ["shard", "_piece"])
        .withColumn("slot", F.explode(F.sequence(F.col("_first") + F.col("_upto") - F.col("_rows"), F.col("_first") + F.col("_upto") - 1)))
        .select(*columns, "shard", "slot")
    )


def op1_sharding(spark, folder: str) -> DataFrame:
    """16 shards in two regions of two racks of four, law ``key``."""
    tree = Tree.regular(2, 2, 4)
    text = text_or_empty()
    placed = assign(documents(spark, folder), tree).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", shard_of(F.col("doc_id"), tree.grown()).alias("grown_shard"),
    )
    return number_slots(placed, len(tree.shards()))
