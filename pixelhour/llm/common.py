"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(), "library")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a local session, as in tests, gets a temporary
    folder; on a cluster it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "llm-checkpoints"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: computed once, whoever reads them and how often."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to a new place in the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder, deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        self.paths: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame) -> DataFrame:
        """The rows as a Parquet table: computed once, whoever reads them and how often."""
        path = f"{shared_folder(self.spark).rstrip('/')}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, *keep: DataFrame) -> None:
        """Delete all tables saved so far but those in ``keep``."""
        gone = [path for table, path in self.paths if not any(table is k for k in keep)]
        self.paths = [(table, path) for table, path in self.paths if path not in gone]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def private(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_or_joined(df: DataFrame, most_rows: int) -> DataFrame:
    """A saved side of a join, broadcast if it has at most ``most_rows`` rows, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs run inside: whole texts then take less memory in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fetched(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of bounded size as arrays on the driver, without a row object each."""
    return {name: column.to_numpy() for name, column in zip(df.columns, df.toArrow().columns, strict=True)}


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows with the highest counts: as many levels of the count as have at most ``most`` rows together.

    Levels are counted first (they are few: a corpus of N tokens has less than
    sqrt(2 N)), so that only the rows wanted travel.
    """
    levels = fetched(counts.groupBy(n).agg(F.count(F.lit(1)).alias("rows")))
    order = np.argsort(-levels[n].astype(np.int64))
    fits = np.cumsum(levels["rows"].astype(np.int64)[order]) <= most
    least = levels[n][order][fits]
    return counts.filter(F.col(n) >= int(least[-1])) if len(least) else counts.limit(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's decimal text, modulo ``modulus``: the folds of held-out rows. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
