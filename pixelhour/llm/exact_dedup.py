"""Exact deduplication by progressive refinement.

Rows are grouped by the length of their text; those whose length occurs twice by
a hash of their first characters too; and only those of a group still shared by
two rows have their whole text hashed. Each level is a count of narrow rows,
combined before the shuffle, so a hot group costs a row per task. What a level's
shared keys hand to the next scan is a bitmap of fixed size, broadcast at every
size of the corpus: a bit set by another key only lets a row through to the next,
exact level. Texts are never shuffled to find copies, and only rows whose whole
text was hashed are joined to their group; all others are alone. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelhour.llm.common import Scratch, documents, text_or_empty

PREFIX_CHARS = 64
ADDED = ("keep_id", "group_size", "kept")
#: Bits of a level's bitmap (16 MB).
FILTER_BITS = 1 << 27


def _place(keys: list[str]) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(FILTER_BITS - 1))


def _again(rows: DataFrame, keys: list[str], before: Column, into: str, scratch: Scratch) -> DataFrame:
    """``rows`` with ``into``: whether ``before`` holds and another such row may have the same keys."""
    shared = rows.filter(before).groupBy(*keys).count().filter("count > 1").select(_place(keys).alias("place"))
    # At most FILTER_BITS / 32768 rows of 4 KB each, whatever the corpus.
    bitmap = scratch.save(shared.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"),
    ))
    bit = F.bitmap_bit_position(_place(keys))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    looked = rows.withColumn("bucket", F.bitmap_bucket_number(_place(keys))).join(F.broadcast(bitmap), "bucket", "left")
    return looked.withColumn(into, before & F.coalesce(found, F.lit(False))).drop("bucket", "bits")


def _levels(docs: DataFrame, whole: Column, prefix_chars: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows with the hash of their whole text (``full``) where it was needed, and the groups of at least two rows.

    Columns of ``docs`` are called given0, given1 …, so none can clash with another.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"), whole.alias("whole"), *[F.col(f"`{c}`").alias(f"given{i}") for i, c in enumerate(docs.columns)],
    ).withColumn("length", F.octet_length("whole"))
    rows = _again(rows, ["length"], F.lit(True), "same_length", scratch)
    rows = rows.withColumn("prefix", F.when(F.col("same_length"), F.xxhash64(F.substring("whole", 1, prefix_chars))))
    rows = _again(rows, ["length", "prefix"], F.col("same_length"), "same_prefix", scratch)
    rows = rows.withColumn("full", F.when(F.col("same_prefix"), F.sha2(F.col("whole").cast("binary"), 256)))
    alike = rows.filter("full is not null").groupBy("full", "id").agg(F.count(F.lit(1)).alias("n"))
    groups = alike.groupBy("full").agg(
        F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "id"), F.sum("n")).alias("ties"),
    ).filter("group_size > 1")
    return rows, scratch.save(groups)


def _marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row with keep_id, group_size and ties; a row whose whole text was not needed meets no group and is not moved."""
    alone = [F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("ties")]
    hashed = rows.filter("full is not null").join(groups, "full", "left")
    single = F.col("group_size").isNull()
    given = [c for c in rows.columns if c.startswith("given")]
    return rows.filter("full is null").select("full", "id", *given, *alone).unionByName(hashed.select(
        "full", "id", *given, F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        *[F.coalesce(c, F.lit(1).cast("long")).alias(c) for c in ("group_size", "ties")],
    ))


def mark_copies(docs: DataFrame, text: str = "text", prefix_chars: int = PREFIX_CHARS, normal: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical (of ``normal``, if given, a column expression);
    null counts as empty. Of equal texts the largest ``doc_id`` stays. A row
    without an id is marked kept only where all its copies lack one, and then all
    of them are, as are rows that repeat the largest id: an id is all that marks
    tell apart (:func:`drop_copies` leaves one of them). Columns of ``docs`` named
    like an added one are replaced. An empty table gives no row.
    """
    whole = normal if normal is not None else text_or_empty(text)
    rows, groups = _levels(docs, whole, prefix_chars, Scratch(docs.sparkSession, "exact-dedup"))
    named = [F.col(f"given{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED]
    return _marked(rows, groups).select(*named, "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, with its columns.

    The largest id stays; of rows that share it, or that all lack an id, the one
    whose columns hash lowest.
    """
    rows, groups = _levels(docs, text_or_empty(), PREFIX_CHARS, Scratch(docs.sparkSession, "exact-dedup"))
    given = [f"given{i}" for i in range(len(docs.columns))]
    kept = _marked(rows, groups).filter(F.col("id").eqNullSafe(F.col("keep_id")))
    out = kept.filter("ties = 1").select(given)
    if not groups.filter("ties > 1").isEmpty():
        tied = kept.filter("ties > 1").groupBy("full").agg(F.min_by(F.struct(*given), F.xxhash64(*given)).alias("row"))
        out = out.unionByName(tied.select("row.*"))
    return out.toDF(*docs.columns)


def op4_exact_dedup(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"))
    return mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
    max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
    count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents)
"""
