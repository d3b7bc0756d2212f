"""New York wall clock, trading sessions and calendars, as columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exchange holidays and early closes (13:00 New York).
HOLIDAYS = [
    date(2025, 1, 1), date(2025, 5, 26), date(2025, 6, 19), date(2025, 7, 4), date(2025, 9, 1), date(2025, 11, 27), date(2025, 12, 25),
    date(2026, 1, 1), date(2026, 5, 25), date(2026, 6, 19), date(2026, 7, 3), date(2026, 9, 7), date(2026, 11, 26), date(2026, 12, 25),
]
HALF_DAYS = [date(2025, 7, 3), date(2025, 11, 28), date(2025, 12, 24), date(2026, 11, 27), date(2026, 12, 24)]
#: Named sessions as minutes of the New York day, half-open; an end of 0 is midnight.
SESSIONS = {"asia": (1080, 0), "london_active": (120, 300), "ny_am": (510, 660), "ny_pm": (810, 960)}
KILLZONES = {"london": (120, 300), "ny_am": (510, 660), "ny_pm": (810, 960)}


def eastern(ts: Column) -> Column:
    """New York wall time of a UTC wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def in_window(minute: Column, start: int, end: int) -> Column:
    """Half-open window, which may wrap around midnight or end there."""
    if end == 0:
        return minute >= start
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def within_any(minute: Column, windows: list[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for start, end in windows:
        found = found | in_window(minute, start, end)
    return found


def active_sessions(ts: Column) -> Column:
    minute = minute_of_day(eastern(ts))
    return F.filter(F.array(*(F.when(in_window(minute, *w), F.lit(n)) for n, w in SESSIONS.items())), lambda x: x.isNotNull())


def killzone(ts: Column) -> Column:
    minute = minute_of_day(eastern(ts))
    return F.coalesce(*(F.when(in_window(minute, *w), F.lit(n)) for n, w in KILLZONES.items()))


def session_day(ts: Column) -> Column:
    """Trade date of a UTC wall time: from 18:00 the next day's; null at 17-18h, on weekends, holidays, after early closes."""
    local = eastern(ts)
    minute = minute_of_day(local)
    day = F.when(minute >= 1080, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
    closed = ((minute >= 1020) & (minute < 1080)) | (F.weekday(day) >= 5) | day.isin(HOLIDAYS) | (day.isin(HALF_DAYS) & (minute >= 780) & (minute < 1020))
    return F.when(~closed, day)


def third_friday(day: Column) -> Column:
    first = F.trunc(day, "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 14)
