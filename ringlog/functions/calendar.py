"""Dates, clock times and calendar keys as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday names, Monday first.
WEEKDAYS = ["Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag"]

Day = dt.date | str | None


def parse_date(text: Column) -> Column:
    """Year, month and day, with hyphens, slashes, dots or spaces or without; else null."""
    text = F.trim(text)
    parted = F.concat_ws(
        "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
    )
    hyphens = F.regexp_replace(text, r"[-/. ]+", "-")
    return F.when(text.rlike(r"^\d{4}([-/. ]+)\d{1,2}([-/. ]+)\d{1,2}$"), hyphens.try_cast("date")).when(
        text.rlike(r"^\d{8}$"), parted.try_cast("date")
    )


def parse_clock(text: Column) -> Column:
    """HH:MM:SS or HH:MM as seconds since midnight, or null."""
    text = F.trim(text)
    valid = text.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$")
    parts = F.split(text, ":")

    def part(k: int) -> Column:
        return F.substring(F.get(parts, F.lit(k)), 1, 2).try_cast("int")

    return F.when(
        valid, part(0) * 3600 + part(1) * 60 + F.coalesce(part(2), F.lit(0))
    )


def clock_text(time_s: Column) -> Column:
    """Seconds since midnight written as HH:MM:SS."""

    def two(value: Column) -> Column:
        return F.lpad(F.floor(value).cast("string"), 2, "0")

    colon = F.lit(":")
    minutes, seconds = two((time_s % 3600) / 60), two(time_s % 60)
    return F.concat(two(time_s / 3600), colon, minutes, colon, seconds)


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def iso_week(day: Column) -> Column:
    return F.weekofyear(day).cast("int")


def hour_of(time_s: Column) -> Column:
    """P9"""
    return F.floor(time_s / 3600).cast("int")


def weekday_no(day: Column) -> Column:
    """P10: Monday is 1."""
    return (F.weekday(day) + 1).cast("int")


def weekday_label(day: Column) -> Column:
    """P10"""
    # Not element_at, which takes a null index for the last one in ANSI mode.
    return F.get(F.array(*[F.lit(name) for name in WEEKDAYS]), F.weekday(day))


def display_date(day: Column) -> Column:
    """P20: dd.mm.yyyy"""
    return F.date_format(day, "dd.MM.yyyy")


def as_day(value: Day) -> dt.date | None:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def in_period(calls: DataFrame, start: Day = None, stop: Day = None) -> DataFrame:
    """Calls from start to stop, both included; null leaves that side open.

    Where the table has its partition columns, the same range is put on them,
    as a range of dates alone prunes no partition.
    """
    columns = {"call_date": lambda day: day, "year": lambda day: day.year, "day": lambda day: day}
    for name, part in columns.items():
        if name not in calls.columns:
            continue
        if start is not None:
            calls = calls.filter(F.col(name) >= F.lit(part(as_day(start))))
        if stop is not None:
            calls = calls.filter(F.col(name) <= F.lit(part(as_day(stop))))
    return calls
