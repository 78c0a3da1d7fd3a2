"""Catalog tables that are replaced as a whole, bucketed tables, views, and removal.

A name stands for a view over the newest complete version of a table. Replacing it writes a new version beside the old
one and then swaps the view, which is one catalog operation: readers see all of the old rows or all of the new ones, and
a job that fails on the way leaves the old ones in place. The version before stays for readers that are still at it and
goes with the next replacement.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import tables

_MARK = "_v"


def _database(spark: SparkSession, name: str) -> tuple[str, str]:
    database, _, table = name.rpartition(".")
    return database or spark.catalog.currentDatabase(), table


def versions(spark: SparkSession, name: str) -> list[str]:
    """Full names of the stored versions, oldest first."""
    database, table = _database(spark, name)
    found = spark.catalog.listTables(database, f"{table}{_MARK}*")
    return sorted(f"{database}.{t.name}" for t in found if t.tableType != "VIEW")


def replace(
    df: DataFrame, name: str, dated: bool = False, bucket_by: str | None = None, buckets: int = 8, keep: int = 2
) -> None:
    """Create or replace the table `name`, partitioned by day if dated, in `buckets` buckets of the key if asked for.

    Rows of a bucket and day come from one task, sorted by the key, so that joins and distincts on the key need no
    shuffle and no sort. With one heavy key value its bucket is heavy: bucket by keys with many values.
    """
    spark = df.sparkSession
    database, table = _database(spark, name)
    staged = f"{database}.{table}{_MARK}{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    writer = df.repartition(buckets, bucket_by).write if bucket_by else df.write
    if dated:
        writer = writer.partitionBy(tables.DAY)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    try:
        writer.format("parquet").saveAsTable(staged)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{table} AS SELECT * FROM {staged}")
    for old in versions(spark, name)[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")


def drop(spark: SparkSession, name: str) -> None:
    """Remove the name and every stored version."""
    database, table = _database(spark, name)
    spark.sql(f"DROP VIEW IF EXISTS {database}.{table}")
    for old in versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS {old}")


def view(spark: SparkSession, name: str, table: str, columns: Sequence[str], condition: str | None = None) -> None:
    """Create or replace a lasting view of distinct rows of a catalog table."""
    where = f" WHERE {condition}" if condition else ""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT DISTINCT {', '.join(columns)} FROM {table}{where}")


def with_run_date(df: DataFrame, run_dates: DataFrame, job: str, column: str = tables.DAY) -> DataFrame:
    """Rows of the day that the table of run dates (job, ds) holds for the job.

    The join prunes partitions when it runs: the plan stays the same from day to day and only the day's files are read.
    """
    day = run_dates.where(run_dates["job"] == job).select(run_dates[tables.DAY].alias("_day"))
    return df.join(day, df[column] == day["_day"], "left_semi")


def stored(
    spark: SparkSession, roles: dict[str, Callable[[], DataFrame]], prefix: str, key: str, buckets: int = 8
) -> dict[str, DataFrame]:
    """Role tables as bucketed catalog tables, dated where they have a day; read back by role name."""
    found = {}
    for name, make in roles.items():
        df = make()
        replace(df, f"{prefix}_{name}", dated=tables.DAY in df.columns, bucket_by=key, buckets=buckets)
        found[name] = spark.table(f"{prefix}_{name}")
    return found


def today_condition(zone: str, lag_days: int) -> str:
    """SQL test for the newest complete day by the clock of the cluster; folded when a query is planned."""
    now = f"to_date(convert_timezone('{zone}', CAST(current_timestamp() AS TIMESTAMP_NTZ)))"
    return f"{tables.DAY} = date_sub({now}, {lag_days})"
