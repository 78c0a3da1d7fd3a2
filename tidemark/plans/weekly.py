"""Weekly series from stored sums per day: a new day costs that day, not the weeks before.

Each run writes the days that no earlier run covers, a folder per stretch of days with the stretch in its name. A job
per day makes a folder per day, a long first run one folder in all; days without rows are covered as well.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import calibration
from tidemark.sources import tables

_RUN = "run"
_SUMS = ("impressions", "conversions", "predicted_conversions", "revenue")


def _stretches(days: list[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """Sorted days as (first, last) of each run of neighbours."""
    found: list[tuple[dt.date, dt.date]] = []
    for day in days:
        if found and day - found[-1][1] == dt.timedelta(days=1):
            found[-1] = (found[-1][0], day)
        else:
            found.append((day, day))
    return found


def covered_days(spark: SparkSession, path: str) -> set[dt.date]:
    """Days that finished runs cover, from folder names alone."""
    found = set()
    for name in tables.folders(spark, path, finished=True):
        first, last = (dt.date.fromisoformat(d) for d in name.removeprefix(f"{_RUN}=").split("_"))
        found |= {first + dt.timedelta(days=i) for i in range((last - first).days + 1)}
    return found


def store_days(facts: DataFrame, start: str, end: str, path: str) -> list[tuple[dt.date, dt.date]]:
    """Traffic sums per day and key under path, for the stretches of the range that are not there yet; those stretches."""
    spark = facts.sparkSession
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    done = covered_days(spark, path)
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    missing = _stretches([d for d in days if d not in done])
    for low, high in missing:
        sums = calibration.traffic(facts, low, high, "day").withColumnRenamed("day", tables.DAY)
        # A run that failed half way has no mark of its end, and is written over.
        sums.write.mode("overwrite").parquet(f"{path}/{_RUN}={low}_{high}")
    return missing


def weeks(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Traffic per week and key, from the stored days of the range."""
    days = tables.scan_days(spark, path, start, end).drop(_RUN)
    keys = [c for c in days.columns if c not in (*_SUMS, tables.DAY)]
    week = dates.week_start(F.col(tables.DAY)).alias("week")
    return days.groupBy(week, *keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
