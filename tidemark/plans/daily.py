"""Per-day runs over an inclusive date range as one job.

All days are worked out in one plan and written with dynamic partition
overwrite, so re-running a range replaces just its days. Days that came out
empty write no rows; a marker beside the table tells that they were run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import tables

#: Folder of the markers; names that start with an underscore are no data to readers.
_EMPTY = "_empty"


def run_days(
    source: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    per_day: Callable[[DataFrame], DataFrame],
    path: str,
    files_per_day: int | None = None,
) -> DataFrame:
    """Apply per_day to the range, replace those days under path, return rows per day.

    per_day must keep the day column and treat days apart (day in its group keys).
    """
    days = tables.between_days(source, start, end)
    tables.replace_days(per_day(days), path, files_per_day)
    written = source.sparkSession.read.parquet(path)
    return (
        tables.between_days(written, start, end)
        .groupBy(tables.DAY)
        .agg(F.count("*").alias("rows"))
    )


def _date(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def missing_days(spark: SparkSession, path: str, start: dt.date | str, end: dt.date | str) -> list[dt.date]:
    """Days of the range that were never run, from folder names alone."""
    first, last = _date(start), _date(end)
    done = tables.stored_days(spark, path) | tables.stored_days(spark, f"{path}/{_EMPTY}")
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    return [day for day in days if day not in done]


def run_missing(
    source: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    per_day: Callable[[DataFrame], DataFrame],
    path: str,
    files_per_day: int | None = None,
) -> list[dt.date]:
    """Run the days of the range that were never run, and those only; the days that were run.

    One job reads just the missing days of a dated source; where none is missing nothing is read. The table is
    extended by whole days, so a job that fails can be started again and goes on where it stopped.
    """
    spark = source.sparkSession
    days = missing_days(spark, path, start, end)
    if not days:
        return []
    # Literals of the day column prune the source's partitions.
    wanted = source.where(F.col(tables.DAY).isin([F.lit(str(d)).cast("date") for d in days]))
    tables.replace_days(per_day(wanted), path, files_per_day)
    for day in set(days) - tables.stored_days(spark, path):
        tables.make_folder(spark, f"{path}/{_EMPTY}/{tables.DAY}={day}")
    return days


def csv_per_day(df: DataFrame, path: str) -> None:
    """CSV output with one folder per day."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(tables.DAY)
        .csv(path)
    )
