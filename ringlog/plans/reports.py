"""The reports as they are shown and exported."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ringlog.functions.calendar import Day
from ringlog.operators.origin import origin_report, pivot_origins, with_origin_headings
from ringlog.operators.period import UNITS, newest_first, period_report, with_headings
from ringlog.schema import state_table
from ringlog.sources.export import export_report


def report(calls: DataFrame, kind: str, start: Day = None, stop: Day = None) -> DataFrame:
    """Report of a kind (day, week, month, year, origin), newest first.

    calls are those of the fact table, whose first_call refers to the whole
    history; start and stop only choose what is reported.
    """
    if kind == "origin":
        by_week = origin_report(calls, state_table(calls.sparkSession), start, stop)
        return newest_first(pivot_origins(by_week))
    if kind not in UNITS:
        raise ValueError(f"no report of kind {kind}")
    return newest_first(period_report(calls, kind, start, stop))


def shown(calls: DataFrame, kind: str, start: Day = None, stop: Day = None) -> DataFrame:
    """The same under the headings its readers know."""
    found = report(calls, kind, start, stop)
    return with_origin_headings(found) if kind == "origin" else with_headings(found)


def export(
    calls: DataFrame,
    kind: str,
    folder: str,
    start: Day = None,
    stop: Day = None,
    format: str = "csv",
) -> str:
    """Write a report to a folder, under a name that says what is in it."""
    return export_report(report(calls, kind, start, stop), folder, kind, format)
