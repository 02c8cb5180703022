"""Weekly series of complete weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlog.functions import in_period, iso_week, iso_year
from ringlog.functions.calendar import Day
from ringlog.schema import ALL_STATES


def choose(
    calls: DataFrame,
    only_success: bool = False,
    only_first: bool = False,
    state: str = ALL_STATES,
) -> DataFrame:
    """P8"""
    if only_success:
        calls = calls.filter("success")
    if only_first:
        calls = calls.filter("first_call")
    if state != ALL_STATES:
        calls = calls.filter(F.col("state") == state)
    return calls


def weekly_series(
    calls: DataFrame,
    start: Day = None,
    stop: Day = None,
    only_success: bool = True,
    only_first: bool = False,
    state: str = ALL_STATES,
) -> DataFrame:
    """Calls per ISO week, for weeks that have calls from Monday to Sunday.

    A week counts as complete if some chosen call is on its Monday and some on
    its Sunday. Weeks without calls are not filled in.
    """
    chosen = in_period(choose(calls, only_success, only_first, state), start, stop)
    return (
        chosen.groupBy(
            iso_year(F.col("call_date")).alias("iso_year"),
            iso_week(F.col("call_date")).alias("iso_week"),
        )
        .agg(
            F.count("*").alias("n_calls"),
            F.min("call_date").alias("start_date"),
            F.max("call_date").alias("end_date"),
        )
        .filter(F.date_add("start_date", 6) == F.col("end_date"))
    )
