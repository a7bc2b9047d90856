"""Dates that keep their precision: a month is a month, never its first or middle day."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.session import ship_active

#: Label of an entry without a date.
UNKNOWN = "Unknown event date"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DAY, _YEAR = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), re.compile("[0-9]{4}")
_NAMED_DAY, _NAMED_MONTH = re.compile(r"([A-Za-z]+)\s+([0-9]{1,2}),?\s+([0-9]{4})"), re.compile(r"([A-Za-z]+)\s*([0-9]{1,4})")
_MONTH = re.compile(r"([0-9]{1,4})-([0-9]{1,2})")
_MOMENT = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]+))?([Zz]|[+-][0-9]{2}:[0-9]{2})")
_STRUCT = "label string, start string, end string, precision string, status string"

Reading = tuple[str | None, str | None, str, str]
_NOTHING: Reading = (None, None, "unknown", "unknown")


def _month_of(word: str) -> int | None:
    word = word.lower()
    return next((n for n, name in enumerate(MONTHS, 1) if word in (name, name[:3])), None)


def _moment(value: str) -> str | None:
    m = _MOMENT.fullmatch(value)
    if not m:
        return None
    try:
        at = datetime.fromisoformat(f"{m[1]}T{m[2]}").replace(tzinfo=UTC)
        if m[4] not in "Zz":
            hours, minutes = int(m[4][1:3]), int(m[4][4:])
            if hours > 23 or minutes > 59:
                return None
            at -= timedelta(hours=hours, minutes=minutes) * (1 if m[4][0] == "+" else -1)
    except (ValueError, OverflowError):
        return None
    return f"{at:%Y-%m-%dT%H:%M:%S}.{((m[3] or '') + '000')[:3]}Z"


@lru_cache(1 << 16)
def read(value: str) -> Reading:
    """(start, end, precision, status) of one date string.

    "A to B" and "A..B" are intervals from A's start to B's end, if these are in order; then an
    instant, a year, a day or a month is looked for in the whole string.
    """
    for mark in (" to ", ".."):
        left, found, right = value.partition(mark)
        if found:
            start, end = read(left.strip())[0], read(right.strip())[1]
            if start and end and start <= end:
                return start, end, "interval", "approximate"
            break
    if at := _moment(value):
        return at, at, "timestamp", "known"
    if _YEAR.fullmatch(value) and int(value):
        return f"{value}-01-01", f"{value}-12-31", "year", "approximate"
    try:
        named = _NAMED_DAY.fullmatch(value)
        day = date.fromisoformat(value) if _DAY.fullmatch(value) else date(int(named[3]), _month_of(named[1]) or 0, int(named[2])) if named else None
    except ValueError:
        day = None
    if day:
        return day.isoformat(), day.isoformat(), "day", "known"
    month = _MONTH.fullmatch(value) or _NAMED_MONTH.fullmatch(value)
    if month:
        year, number = (int(month[1]), int(month[2])) if month.re is _MONTH else (int(month[2]), _month_of(month[1]) or 0)
        if 1 <= number <= 12 and 1 <= year <= 9999:
            return f"{year:04}-{number:02}-01", f"{year:04}-{number:02}-{calendar.monthrange(year, number)[1]:02}", "month", "approximate"
    return _NOTHING


def qualified(values: list[str | None] | None) -> tuple[str, str | None, str | None, str, str]:
    """(label, start, end, precision, status) of all date strings that are given for one event; see qualify()."""
    distinct = sorted({v.strip() for v in values if v is not None}) if values is not None else []
    if len(distinct) > 1:
        return "; ".join(distinct), None, None, "unknown", "conflicting"
    return (distinct[0], *read(distinct[0])) if distinct else (UNKNOWN, *_NOTHING)


def qualify(values: Column) -> Column:
    """struct(label, start, end, precision, status) of all date strings that are given for one event.

    Trimmed strings that differ are conflicting, whatever days they mean; an empty one is a string
    like others, null is none. Strings repeat much more often than they differ, so each task reads
    a distinct one once and looks it up again afterwards.
    """

    def each(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([qualified(v) for v in lists], columns=["label", "start", "end", "precision", "status"])

    each.__annotations__ = {"lists": pd.Series, "return": pd.DataFrame}
    ship_active()
    return F.pandas_udf(each, _STRUCT)(values)
