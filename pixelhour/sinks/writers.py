"""File outputs: reports, dumps, archives, daily documents and their yearly compaction."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelhour.operators import documents
from pixelhour.operators.readings import clock_literal


def write_csv_dump(table: DataFrame, path: str) -> None:
    """The whole table as gzip CSV with header; quotes inside values are doubled."""
    (
        table.write.mode("overwrite").option("header", True).option("compression", "gzip")
        .option("quote", '"').option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )


def read_csv_dump(spark: SparkSession, path: str, schema) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per line; absent values are written as null."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_daily_report(report: DataFrame, root: str, day: date) -> None:
    """The report of one date under year=/month=/day=; writing a date, also without rows, replaces only that date."""
    write_report(report, f"{root}/year={day:%Y}/month={day:%m}/day={day:%d}")


def write_raw_archive(messages: DataFrame, root: str, run: datetime | Column, batch_id: int) -> None:
    """Messages separated by a blank line under date/hour/minute of the run, and the batch that wrote them.

    Writing a batch of a run again replaces it; no messages write nothing.
    """
    moment = clock_literal(run)
    parts = [F.date_format(moment, form).alias(name) for name, form in (("date", "yyyy-MM-dd"), ("hour", "HH"), ("minute", "mm"))]
    (
        messages.select("value", *parts, F.lit(batch_id).alias("batch")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("lineSep", "\n\n").partitionBy("date", "hour", "minute", "batch").text(root)
    )


def read_raw_archive(spark: SparkSession, root: str) -> DataFrame:
    """Archived messages with their date, hour, minute and batch."""
    return spark.read.option("basePath", root).option("lineSep", "\n\n").text(f"{root}/date=*/hour=*/minute=*/batch=*")


def write_daily_documents(typed: DataFrame, root: str, batch_id: int) -> None:
    """Typed documents partitioned by index date. A repeated batch replaces its own partition only."""
    (
        typed.withColumn("batch", F.lit(batch_id).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("index_date", "batch").parquet(root)
    )


def compact_year(spark: SparkSession, daily_root: str, yearly_root: str, year: int) -> None:
    """All daily datasets of a year into one yearly dataset with evenly sized files.

    ``rebalance`` lets adaptive execution split a heavy day and join light ones
    into files of the advisory partition size.
    """
    merged = documents.of_year(spark.read.parquet(daily_root), year).withColumn("year", F.lit(year))
    (
        merged.hint("rebalance")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(yearly_root)
    )


def retire_year(spark: SparkSession, daily_root: str, yearly_root: str, year: int) -> list[date]:
    """Delete a year's daily datasets, once the yearly one has as many rows of every day, and return their dates.

    A day that the yearly dataset lacks, or has other rows of, is an error, and
    nothing is deleted. A year that is gone already is no error. Other years'
    files are not touched.
    """
    daily = documents.of_year(spark.read.parquet(daily_root), year).groupBy("index_date").agg(F.count(F.lit(1)).alias("n"))
    kept = spark.read.parquet(yearly_root).filter(F.col("year") == year).groupBy("index_date").agg(F.count(F.lit(1)).alias("kept"))
    # At most 366 rows.
    days = daily.join(kept, "index_date", "left").orderBy("index_date").collect()
    if missing := [str(r["index_date"]) for r in days if r["n"] != r["kept"]]:
        raise ValueError(f"not compacted yet: {', '.join(missing)}")
    for r in days:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{daily_root}/index_date={r['index_date']}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return [r["index_date"] for r in days]


def monthly_rows(table: DataFrame, gte: datetime, lte: datetime, time_col: str = "service_uploaded") -> DataFrame:
    """Rows of the whole months touched by [gte, lte], with their ``month`` (first day).

    The half-open range on the plain column reaches the scan.
    """
    first = date(gte.year, gte.month, 1)
    after = date(lte.year + lte.month // 12, lte.month % 12 + 1, 1)
    moment = F.col(time_col)
    bound = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    inside = table.filter((moment >= bound(first)) & (moment < bound(after)))
    return inside.withColumn("month", F.trunc(moment, "MM"))


def write_monthly_report(table: DataFrame, root: str, gte: datetime, lte: datetime, sort: list[str],
                         time_col: str = "service_uploaded") -> None:
    """One folder of CSV files per month, rows in report order. Other months stay as they are.

    Range partitioning on (month, sort columns) spreads a heavy month over
    several sorted files whose names follow the order, instead of one task.
    """
    rows = monthly_rows(table, gte, lte, time_col)
    (
        rows.repartitionByRange("month", *sort).sortWithinPartitions("month", *sort)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).option("escape", '"')
        .partitionBy("month").csv(root)
    )
