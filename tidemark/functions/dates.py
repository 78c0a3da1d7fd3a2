"""Run dates, day codes and period labels."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "America/Los_Angeles"
RUN_LAG_DAYS = 2
#: Ways to write a time besides ISO, tried in this order.
TIME_FORMATS = (
    "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "MMM d, yyyy H:mm:ss", "MMM d, yyyy H:mm", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
)


def default_run_date(now: dt.datetime | None = None, zone: str = DEFAULT_ZONE) -> dt.date:
    """Two days before today in the zone: the newest day that is surely complete.

    Jobs take the run date as an argument; this is only the default of an entry point.
    """
    moment = now or dt.datetime.now(dt.timezone.utc)
    return moment.astimezone(ZoneInfo(zone)).date() - dt.timedelta(days=RUN_LAG_DAYS)


def today_minus(days: int, zone: str = DEFAULT_ZONE) -> Column:
    """The same as a column, for SQL that must follow the clock of the cluster."""
    local = F.convert_timezone(None, F.lit(zone), F.current_timestamp().cast("timestamp_ntz"))
    return F.date_sub(F.to_date(local), days)


def day(value: dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def look_back(run_date: dt.date | str, upper: int, lower: int = 0) -> tuple[Column, Column]:
    """Inclusive day range from run date - upper to run date - lower."""
    return F.date_sub(day(run_date), upper), F.date_sub(day(run_date), lower)


def day_code(value: Column, short: bool = False) -> Column:
    return F.date_format(value, "yyMMdd" if short else "yyyyMMdd")


def parse_day_code(text: Column, short: bool = False) -> Column:
    return F.to_date(text, "yyMMdd" if short else "yyyyMMdd")


def months_before(value: Column, months: int) -> Column:
    """Month arithmetic that clamps to the end of shorter months."""
    return F.add_months(value, -months)


def years_before(value: Column, years: int) -> Column:
    return F.add_months(value, -12 * years)


def week_start(value: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", value).cast("date")


def quarter_label(value: Column) -> Column:
    return F.concat(F.year(value), F.lit("Q"), F.quarter(value))


def quarter_bounds(label: str) -> tuple[dt.date, dt.date]:
    """First and last day of a quarter such as 2000Q1."""
    year, quarter = (int(part) for part in label.split("Q"))
    after = dt.date(year + quarter // 4, 3 * (quarter % 4) + 1, 1)
    return dt.date(year, 3 * quarter - 2, 1), after - dt.timedelta(days=1)


def month_label(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def from_epoch_millis(text: Column) -> Column:
    return F.timestamp_millis(text.try_cast("bigint"))


def lenient_timestamp(text: Column) -> Column:
    """Timestamp of ISO text or of one of TIME_FORMATS, or NULL for text that is none."""
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])
