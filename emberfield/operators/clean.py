"""Filters and small column edits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(value: str | dt.date) -> Column:
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def _day_after(value: str | dt.date) -> Column:
    day = value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
    return F.lit(day + dt.timedelta(days=1))


def keep_present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with a value in every named column."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
    return df


def in_window(date: str | Column, start: str | dt.date | None = None, end: str | dt.date | None = None) -> Column:
    """True inside a closed window of days; either end may be open.

    The comparison is with the column itself, and the upper bound is "before the next day", so
    it reaches the file scan for date and for timestamp columns alike.
    """
    col = F.col(date) if isinstance(date, str) else date
    test = F.lit(True)
    if start is not None:
        test = test & (col >= _date(start))
    if end is not None:
        test = test & (col < _day_after(end))
    return test


def filter_since(df: DataFrame, date: str, start: str | dt.date) -> DataFrame:
    return df.filter(in_window(date, start=start))


def filter_window(df: DataFrame, date: str, start: str | dt.date, end: str | dt.date) -> DataFrame:
    return df.filter(in_window(date, start, end))


def keep_positive(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col) > 0)


def clip_range(df: DataFrame, col: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows inside axis limits; a limit of None is open."""
    if low is not None:
        df = df.filter(F.col(col) >= low)
    if high is not None:
        df = df.filter(F.col(col) <= high)
    return df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def constant(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})
