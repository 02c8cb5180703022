"""Reports as files for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the exported reports.
REPORT_NAMES = {
    "day": "tagestabelle",
    "week": "wochentabelle",
    "month": "monatstabelle",
    "year": "jahrestabelle",
    "origin": "herkunftstabelle",
}


def export_name(report: DataFrame, kind: str) -> DataFrame:
    """One row with the name of the file: kind, first and last period in it."""
    first, last = {
        "day": ("call_date", "call_date"),
        "year": ("year", "year"),
    }.get(kind, ("first_date", "last_date"))
    return report.agg(
        F.concat_ws(
            "_",
            F.lit(REPORT_NAMES[kind]),
            F.min(first).cast("string"),
            F.max(last).cast("string"),
        ).alias("name")
    )


def export_report(report: DataFrame, folder: str, kind: str, format: str = "csv") -> str:
    """Write a report under its name and say where."""
    path = f"{folder.rstrip('/')}/{export_name(report, kind).first().name}"
    writer = report.write.mode("overwrite")
    if format == "csv":
        writer.option("header", "true").option("escape", '"').csv(path)
    else:
        writer.format(format).save(path)
    return path
