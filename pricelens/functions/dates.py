"""Date column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "to_date_safe", "epoch_ms_to_date", "epoch_s_to_year", "month_start",
    "month_grid", "month_offset", "first_month_on_or_after",
    "corrected_release_year", "forecast_start", "month_label",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_date_safe(c) -> Column:
    """Coercing parse: anything that is not a date becomes NULL."""
    return F.try_to_timestamp(_c(c).cast("string")).cast("date")


def epoch_ms_to_date(ms) -> Column:
    return F.to_date(F.timestamp_millis(_c(ms).cast("bigint")))


def epoch_s_to_year(s) -> Column:
    return F.year(F.timestamp_seconds(_c(s).cast("bigint")))


def month_start(d) -> Column:
    return F.trunc(_c(d), "MM")


def first_month_on_or_after(d) -> Column:
    """First day of the month of ``d`` if ``d`` is a first, else of the next
    month (a month-start grid rolls a mid-month start forward)."""
    d = _c(d)
    return F.when(F.dayofmonth(d) == 1, d).otherwise(F.trunc(F.add_months(d, 1), "MM"))


def month_grid(start, end) -> Column:
    """Array of month starts from ``start`` (rolled forward) through ``end``."""
    s = first_month_on_or_after(start)
    return F.when(s <= _c(end), F.sequence(s, _c(end), F.expr("INTERVAL 1 MONTH"))) \
            .otherwise(F.array().cast("array<date>"))


def month_offset(d, ref) -> Column:
    """Signed calendar-month distance ``d - ref``."""
    d, ref = _c(d), _c(ref)
    return (F.year(d) - F.year(ref)) * 12 + F.month(d) - F.month(ref)


def corrected_release_year(meta_year, first_sale_year, floor_year: int = 2005) -> Column:
    """Earliest plausible release year: min of the metadata year and the first
    sale year, each only if >= ``floor_year``; otherwise the metadata year."""
    y, f = _c(meta_year), _c(first_sale_year)
    return F.coalesce(F.least(F.when(y >= floor_year, y), F.when(f >= floor_year, f)), y)


def forecast_start(last_date, global_start) -> Column:
    """First of the month after the last observation, never before the global
    start; no history -> the global start."""
    nxt = F.trunc(F.add_months(_c(last_date), 1), "MM")
    return F.greatest(nxt, _c(global_start))


def month_label(d) -> Column:
    """``Mon YYYY`` label; NULL -> dash."""
    return F.coalesce(F.date_format(_c(d), "MMM yyyy"), F.lit("—"))
