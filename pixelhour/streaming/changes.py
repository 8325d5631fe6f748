"""Groups of a streaming aggregation as a table that batch plans can read.

The aggregation itself, and what has been counted, is Spark's: groups are kept in
the state store of the query's checkpoint, and a micro-batch emits the groups it
changed, each with its whole new value. They are appended in one write, with the
number of the micro-batch; a group's current value is the one of its newest
micro-batch. A micro-batch that is written again says the same again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = T.StructField("batch_id", T.LongType())


def append(changed: DataFrame, root: str, batch_id: int, *partition_by: str) -> None:
    """Add a micro-batch's changed groups. Rebalancing by partition keeps files few and splits a heavy one by size."""
    rows = changed.withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows = rows.hint("rebalance", *partition_by) if partition_by else rows.hint("rebalance")
    rows.write.mode("append").partitionBy(*partition_by).parquet(root)


def read(spark: SparkSession, root: str, schema: T.StructType, inside: str = "") -> DataFrame:
    """All rows written so far, or those of the partition folders ``inside`` matches; none if there is no table yet."""
    try:
        return spark.read.schema(schema).option("basePath", root).parquet(f"{root}{inside}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The current value of every group of ``rows``: one aggregation, combined before its shuffle."""
    values = [c for c in rows.columns if c not in (*key, "batch_id")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch_id").alias("now")).select(*key, "now.*")


def compact(spark: SparkSession, root: str, schema: T.StructType, key: list[str], partition_by: list[str], chosen) -> None:
    """Rewrite the partitions that the condition ``chosen`` selects with their current values only.

    Spark replaces just those partitions, when the new files are complete. The
    stream must not write to them meanwhile: compact days that are long over, or
    between two runs.
    """
    rows = read(spark, root, schema).filter(chosen)
    values = [c for c in rows.columns if c not in key]
    now = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch_id").alias("now")).select(*key, "now.*")
    (
        now.select(*rows.columns).hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by).parquet(root)
    )
