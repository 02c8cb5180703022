"""Where the calls of each week came from."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ringlog.functions import count_callers, in_period, iso_week, iso_year, origin_label
from ringlog.functions.calendar import Day
from ringlog.schema import MOBILE, STATES, UNKNOWN

MEASURES = ("calls", "callers", "first_callers")
WEEK = ("iso_year", "iso_week")

# Calls whose origin has no label at all; cleaning leaves none.
UNLABELLED = "NA"
ORIGINS = [MOBILE, *sorted(code for _, code in STATES), UNKNOWN]


def add_origin(calls: DataFrame, states: DataFrame) -> DataFrame:
    """The short code of the state, and the label of the origin."""
    codes = states.select("state", "state_code")
    return calls.join(codes, "state", "left").withColumn(
        "origin", origin_label(F.col("state_code"), F.col("is_landline"))
    )


def _week_keys(calls: DataFrame) -> DataFrame:
    day = F.col("call_date")
    return calls.withColumns({"iso_year": iso_year(day), "iso_week": iso_week(day)})


def with_week_bounds(calls: DataFrame) -> DataFrame:
    """First and last day with a call in the same week, on every call.

    The weeks are aggregated first; there are at most 53 in a year, so they
    are broadcast and the calls are not shuffled.
    """
    calls = _week_keys(calls)
    weeks = calls.groupBy(*WEEK).agg(
        F.min("call_date").alias("week_first"), F.max("call_date").alias("week_last")
    )
    return calls.join(F.broadcast(weeks), list(WEEK), "left")


def origin_report(
    calls: DataFrame, states: DataFrame, start: Day = None, stop: Day = None
) -> DataFrame:
    """Calls, callers and first-time callers per week and origin.

    first_date and last_date are those of the week over all origins. They come
    from the aggregated rows, of which a week has one for each origin.
    """
    week = Window.partitionBy(*WEEK)
    return (
        _week_keys(add_origin(in_period(calls, start, stop), states))
        .groupBy(*WEEK, "origin")
        .agg(
            F.min("call_date").alias("first_date"),
            F.max("call_date").alias("last_date"),
            F.count("*").alias("calls"),
            count_callers().alias("callers"),
            F.sum(F.col("first_call").cast("int")).alias("first_callers"),
        )
        .withColumn("first_date", F.min("first_date").over(week))
        .withColumn("last_date", F.max("last_date").over(week))
    )


def column_of(origin: str, measure: str) -> str:
    """Name of a pivoted column, such as bw_calls or unbk_callers."""
    return f"{re.sub('[^a-z]', '', origin.lower())}_{measure}"


def pivot_origins(
    report: DataFrame, origins: Sequence[str] | None = None, only_present: bool = False
) -> DataFrame:
    """One row per week, one column per origin and measure.

    Column order: week, totals over the origins, mobile, the others by name.
    A caller seen under two origins counts in both and twice in the total. By
    default there is a column for each possible origin. only_present asks the
    report which ones occur, as the shown report does; give it a report that is
    written or stored, or it is computed for that first.
    """
    labelled = report.withColumn("origin", F.coalesce("origin", F.lit(UNLABELLED)))
    if only_present:
        # No more than there are states, and three labels besides.
        origins = [row.origin for row in labelled.select("origin").distinct().collect()]
    origins = list(origins or [*ORIGINS, UNLABELLED])
    mobile = [o for o in origins if o == MOBILE]
    columns = {
        column_of(origin, measure): (origin, measure)
        for origin in mobile + sorted(set(origins) - set(mobile))
        for measure in MEASURES
    }

    def cell(origin: str, measure: str) -> Column:
        return F.sum(F.when(F.col("origin") == origin, F.col(measure)))

    zero = F.lit(0).cast("bigint")
    # The year becomes text only after the groups, whose rows already lie together.
    return (
        labelled.groupBy(*WEEK, "first_date", "last_date")
        .agg(
            *[F.sum(measure).alias(f"all_{measure}") for measure in MEASURES],
            *[
                F.coalesce(cell(origin, measure), zero).alias(name)
                for name, (origin, measure) in columns.items()
            ],
        )
        .withColumn("iso_year", F.col("iso_year").cast("string"))
    )


def origin_totals(
    calls: DataFrame, states: DataFrame, start: Day = None, stop: Day = None
) -> DataFrame:
    """The same measures per state over the whole period, and in all.

    The row over all states has no state and is_total set; unlike the pivoted
    totals it counts each caller once.
    """
    return (
        add_origin(in_period(calls, start, stop), states)
        .rollup("origin")
        .agg(
            F.grouping("origin").cast("boolean").alias("is_total"),
            F.count("*").alias("calls"),
            count_callers().alias("callers"),
            F.sum(F.col("first_call").cast("int")).alias("first_callers"),
        )
    )


# How the measures are called in the shown report.
MEASURE_HEADINGS = {
    "calls": "Anrufe",
    "callers": "Anrufer*innen",
    "first_callers": "Erstanrufer*innen",
}


def with_origin_headings(pivoted: DataFrame, origins: Sequence[str] | None = None) -> DataFrame:
    """Columns named by origin and measure, such as "BW Anrufer*innen"."""
    names = {
        "iso_year": "Jahr",
        "iso_week": "Kalenderwoche",
        "first_date": "Start",
        "last_date": "Ende",
    }
    names |= {f"all_{m}": f"Alle {heading}" for m, heading in MEASURE_HEADINGS.items()}
    names |= {
        column_of(origin, m): f"{origin} {heading}"
        for origin in origins or [*ORIGINS, UNLABELLED]
        for m, heading in MEASURE_HEADINGS.items()
    }
    return pivoted.withColumnsRenamed({k: v for k, v in names.items() if k in pivoted.columns})
