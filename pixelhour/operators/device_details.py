"""Which urn and serial number belong to a device, and filling them into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.session import written

DETAIL_FIELDS = ("device_sn", "device_urn")
MIN_DOCUMENTS = 3


def top_devices(documents: DataFrame, size: int) -> DataFrame:
    """The devices with most documents: device, n. Exact; ties by device number."""
    counts = documents.filter(F.col("device").isNotNull()).groupBy("device").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "device").limit(size)


def term_counts(documents: DataFrame) -> DataFrame:
    """device, field, term (NULL where absent), fg_count: the one pass over the documents."""
    pairs = ", ".join(f"'{f}', {f}" for f in DETAIL_FIELDS)
    long = documents.filter(F.col("device").isNotNull()).select(
        "device", F.expr(f"stack({len(DETAIL_FIELDS)}, {pairs}) as (field, term)")
    )
    return long.groupBy("device", "field", "term").agg(F.count(F.lit(1)).alias("fg_count"))


def _documents_per_device(counts: DataFrame) -> DataFrame:
    """device, n: every document counts once under each field, so one field gives the total."""
    one_field = counts.filter(F.col("field") == DETAIL_FIELDS[0])
    return one_field.groupBy("device").agg(F.sum("fg_count").alias("n"))


def significant_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """device, field, term, fg_count, score for terms more common in a device's documents than overall.

    Score: (fg - bg) * fg / bg with the shares of documents holding the term in
    the device's and in all documents.
    """
    per_device = _documents_per_device(counts)
    terms = counts.filter(F.col("term").isNotNull())
    per_term = terms.groupBy("field", "term").agg(F.sum("fg_count").alias("bg_count"))
    total = per_device.agg(F.sum("n")).scalar()
    scored = (
        terms.filter(F.col("fg_count") >= min_documents)
        .join(per_term, ["field", "term"]).join(per_device, "device")
        .withColumn("fg", F.col("fg_count") / F.col("n"))
        .withColumn("bg", F.col("bg_count") / total)
        .filter(F.col("fg") > F.col("bg"))
    )
    return scored.select(
        "device", "field", "term", "fg_count", ((F.col("fg") - F.col("bg")) * F.col("fg") / F.col("bg")).alias("score")
    )


def device_details(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """device, device_sn, device_urn: the most significant term of each field for each device.

    The counts are written once and everything else derives from them, so the
    documents are read a single time. Equal scores go to the term with more
    documents, then to the smaller term.
    """
    counts = written(term_counts(documents), "term-counts")
    devices = _documents_per_device(counts).select("device")
    terms = significant_terms(counts, min_documents)
    best = terms.groupBy("device", "field").agg(
        F.min(F.struct((-F.col("score")).alias("s"), (-F.col("fg_count")).alias("c"), "term"))["term"].alias("term")
    )
    wide = best.groupBy("device").agg(*[
        F.max(F.when(F.col("field") == f, F.col("term"))).alias(f) for f in DETAIL_FIELDS
    ])
    return devices.join(wide, "device", "left")


def backfill(documents: DataFrame, details: DataFrame) -> DataFrame:
    """Fill missing device_sn / device_urn from the details; documents without a match stay as they are."""
    lookup = details.select("device", *[F.col(f).alias(f"__{f}") for f in DETAIL_FIELDS])
    joined = documents.join(lookup, "device", "left")
    filled = {f: F.coalesce(f, f"__{f}").alias(f) for f in DETAIL_FIELDS}
    return joined.select(*[filled.get(c, F.col(c)) for c in documents.columns])
