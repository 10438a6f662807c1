"""Billing periods, reporting timeframes and request windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col

# --- fixed values: must equal the reference's for right results ---------------------
DEFAULT_PERIODS = 12
WINDOW_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "all": None}


def month_periods(ref: ColumnOrName, n: int = DEFAULT_PERIODS) -> Column:
    """Array of ``n`` first-of-months ending with the month of ``ref``."""
    last = F.trunc(col(ref), "month")
    return F.sequence(F.add_months(last, 1 - n), last, F.expr("interval 1 month"))


def day_periods(ref: ColumnOrName, cap: int | None = None) -> Column:
    """Array of the days of the month of ``ref``, at most ``cap`` of them."""
    first = F.trunc(col(ref), "month")
    days = F.sequence(first, F.last_day(col(ref)), F.expr("interval 1 day"))
    return days if cap is None else F.slice(days, 1, max(0, cap))


def timeframe_range(
    timeframe: str, today: dt.date, custom: tuple[str, str] | None = None
) -> tuple[dt.date, dt.date]:
    """Inclusive first and last day of a named timeframe; unknown names are an error."""
    first = today.replace(day=1)
    if timeframe in ("MonthToDate", "BillingMonthToDate", "WeekToDate"):
        return first, today
    if timeframe in ("TheLastMonth", "TheLastBillingMonth"):
        end = first - dt.timedelta(days=1)
        return end.replace(day=1), end
    if timeframe == "TheLastYear":
        months = today.year * 12 + today.month - 1 - 11
        return dt.date(months // 12, months % 12 + 1, 1), today
    if timeframe == "Custom":
        if custom is None:
            raise ValueError("the Custom timeframe needs a first and a last day")
        return tuple(dt.date.fromisoformat(day[:10]) for day in custom)
    raise ValueError(f"unknown timeframe {timeframe!r}")


def status_class(status: ColumnOrName) -> Column:
    """``2xx`` to ``5xx``; anything outside is pulled to the nearest class."""
    band = F.greatest(F.lit(2), F.least(F.lit(5), F.floor(col(status) / 100).cast("int")))
    return F.concat(band.cast("string"), F.lit("xx"))


def window_cutoff(now: ColumnOrName, window: str) -> Column | None:
    """Oldest instant kept by a named window, or None where there is no bound."""
    seconds = WINDOW_SECONDS[window]
    return None if seconds is None else col(now) - F.expr(f"interval {seconds} seconds")
