"""Dated and plain tables: scans that prune, and repeatable writes."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates

DAY = "ds"


def on_day(df: DataFrame, run_date: dt.date | str) -> DataFrame:
    """One day of a table partitioned by day; the test becomes a partition filter."""
    return df.where(F.col(DAY) == dates.day(run_date))


def between_days(df: DataFrame, start, end, column: str = DAY) -> DataFrame:
    """An inclusive day range; start and end are dates, text or columns."""
    low = dates.day(start) if isinstance(start, (str, dt.date)) else start
    high = dates.day(end) if isinstance(end, (str, dt.date)) else end
    return df.where(F.col(column).between(low, high))


def scan_day(spark: SparkSession, path: str, run_date: dt.date | str) -> DataFrame:
    return on_day(spark.read.parquet(path), run_date)


def scan_days(spark: SparkSession, path: str, start, end) -> DataFrame:
    return between_days(spark.read.parquet(path), start, end)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path and the path for it, by the session's own settings."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job has written, on whatever file system it lies."""
    system, place = _hadoop(spark, path)
    system.delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.mkdirs(place)


def replace_table(df: DataFrame, path: str) -> None:
    """Create or replace an undated table.

    Rows are written beside it first and take its place by renaming, so a job that fails leaves the old rows, and df
    may read the table it replaces. Catalog tables are swapped by sources.catalog in one step.
    """
    spark, side = df.sparkSession, uuid.uuid4().hex[:8]
    staged, old = f"{path.rstrip('/')}__{side}", f"{path.rstrip('/')}__{side}_old"
    try:
        df.write.parquet(staged)
    except BaseException:
        remove(spark, staged)
        raise
    system, place = _hadoop(spark, path)
    if system.exists(place):
        system.rename(place, _hadoop(spark, old)[1])
    system.rename(_hadoop(spark, staged)[1], place)
    remove(spark, old)


def replace_days(df: DataFrame, path: str, files_per_day: int | None = None) -> None:
    """Create or replace only the days that df holds; other days stay as they are.

    With files_per_day rows are spread by day and a hash bucket, so one heavy
    day is written by several tasks and a light one by few.
    """
    if files_per_day:
        df = df.repartition(DAY, F.pmod(F.hash(*df.columns), F.lit(files_per_day)))
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )


def folders(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """Names of the folders right under a path that hold data; finished asks for the mark of a job's end in them."""
    system, place = _hadoop(spark, path)
    if not system.exists(place):
        return []
    found = [s.getPath() for s in system.listStatus(place) if s.isDirectory()]
    if finished:
        found = [f for f in found if system.exists(_hadoop(spark, f"{f.toString()}/_SUCCESS")[1])]
    return sorted(n for f in found if not (n := f.getName()).startswith(("_", ".")))


def stored_days(spark: SparkSession, path: str) -> set[dt.date]:
    """Days that a dated table holds, from the names of its folders alone."""
    names = folders(spark, path)
    return {dt.date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith(f"{DAY}=")}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows"))
