"""Calendar windows, labels and bounds of query parameters; plain dates, no data."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest report, in days, both ends counted.
LONGEST_REPORT = 731
MONTHS_IN = {"month": 1, "quarter": 3, "year": 12}

Window = tuple[date, date]


def as_date(value: str | date | None) -> date | None:
    """A query date: ISO date or date and time, of which the time is ignored."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(value.strip()[:10])


def add_months(day: date, n: int) -> date:
    """The same day n months on, or that month's last."""
    months = day.year * 12 + day.month - 1 + n
    year, month = divmod(months, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def window(day: date, unit: str) -> Window:
    """The calendar month, quarter or year that holds a day."""
    n = MONTHS_IN[unit]
    start = date(day.year, (day.month - 1) // n * n + 1, 1)
    return start, add_months(start, n) - timedelta(days=1)


def previous(span: Window, mode: str) -> Window:
    """The window to compare with: mom and qoq the month or quarter before, yoy the same a year earlier."""
    if mode == "yoy":
        return add_months(span[0], -12), add_months(span[1], -12)
    return window(span[0] - timedelta(days=1), {"mom": "month", "qoq": "quarter"}[mode])


def described(span: Window) -> tuple[str, str]:
    """A window's label and comparison mode."""
    start, end = span
    if span == window(start, "month"):
        return start.strftime("%B %Y"), "mom"
    if span == window(start, "quarter"):
        return f"Q{(start.month + 2) // 3} {start.year}", "qoq"
    if span == window(start, "year"):
        return str(start.year), "yoy"
    return f"{start.isoformat()} – {end.isoformat()}", "yoy"


def check_range(start: date | None, end: date | None, longest: int | None = None) -> None:
    if start and end and start > end:
        raise ValueError("the first day is after the last")
    if longest and start and end and (end - start).days + 1 > longest:
        raise ValueError(f"more than {longest} days")


def bucket_label(bucket: Column, unit: str) -> Column:
    """The label of a month, quarter or year that begins at a timestamp."""
    if unit == "month":
        return F.date_format(bucket, "MMM yyyy")
    if unit == "quarter":
        return F.concat(F.lit("Q"), F.quarter(bucket).cast("string"), F.lit(" "), F.year(bucket).cast("string"))
    return F.year(bucket).cast("string")
