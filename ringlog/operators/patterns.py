"""Calls by weekday and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlog.functions import (
    fail_share,
    hour_of,
    percent_label,
    strict_success,
    weekday_label,
    weekday_no,
)

DAYTIME = (8, 21)


def add_weekday_hour(calls: DataFrame) -> DataFrame:
    """P9, P10"""
    return calls.withColumns(
        {
            "weekday_no": weekday_no(F.col("call_date")),
            "weekday": weekday_label(F.col("call_date")),
            "hour": hour_of(F.col("time_s")),
        }
    )


def in_hours(calls: DataFrame, first: int = 0, last: int = 23) -> DataFrame:
    """Calls from one full hour to another, both included."""
    return calls.filter(hour_of(F.col("time_s")).between(first, last))


def successful_by_hour(calls: DataFrame, strict: bool = False) -> DataFrame:
    """Strict asks for a connection on both sides."""
    success = strict_success() if strict else F.col("success")
    return (
        calls.filter(success)
        .groupBy(hour_of(F.col("time_s")).alias("hour"))
        .agg(F.count("*").alias("n"))
    )


def calls_by_weekday(calls: DataFrame) -> DataFrame:
    """A16"""
    return add_weekday_hour(calls).groupBy("weekday_no", "weekday").agg(F.count("*").alias("n"))


def calls_by_weekday_success(calls: DataFrame) -> DataFrame:
    """A17"""
    return (
        add_weekday_hour(calls)
        .groupBy("weekday_no", "weekday", "success")
        .agg(F.count("*").alias("n"))
    )


def fail_share_by_weekday(calls: DataFrame) -> DataFrame:
    """One row per weekday rather than the same label on every call."""
    return (
        add_weekday_hour(calls)
        .groupBy("weekday_no", "weekday")
        .agg(fail_share().alias("share"))
        .withColumn("share_label", percent_label(F.col("share")))
    )


def heat_table(
    calls: DataFrame, first_hour: int = 0, last_hour: int = 23, only_failed: bool = False
) -> DataFrame:
    """Calls by weekday and hour."""
    calls = in_hours(calls, first_hour, last_hour)
    if only_failed:
        calls = calls.filter(~F.col("success"))
    return (
        add_weekday_hour(calls)
        .groupBy("weekday_no", "weekday", "hour")
        .agg(F.count("*").alias("n"))
    )


def fail_share_table(calls: DataFrame) -> DataFrame:
    """Share of failed calls by weekday and hour."""
    return (
        add_weekday_hour(calls)
        .groupBy("weekday_no", "weekday", "hour")
        .agg(fail_share().alias("share"))
    )
