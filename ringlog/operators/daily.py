"""A1-A5 from measures by day that add up, so that a report reads days and no call.

Counts and sums of days add up to those of weeks, months and years; the greatest talk
time is the greatest of the days'; distinct callers do not add up, so a day keeps a
sketch of them (HyperLogLog), and the sketches of a period are merged. What is counted
exactly stays exact. The number of callers is an estimate, with a standard error of
about 1.04 / sqrt(2 ** SKETCH_BITS).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlog.functions import in_period
from ringlog.functions.calendar import Day
from ringlog.operators.period import UNITS, period_keys, rounded_minutes

SKETCH_BITS = 12


def day_measures(calls: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """One row for each day with a call: what reports need of it, and a sketch of its callers.

    Withheld numbers are no part of the sketch; whether there are any is kept beside it.
    """
    talk = F.when(F.col("success"), F.col("duration_out"))
    return calls.groupBy("call_date").agg(
        F.count("caller").alias("calls"),
        F.count_if(F.col("success")).alias("calls_ok"),
        F.count_if(talk < 60).alias("calls_lt_1min"),
        F.sum(talk).alias("talk"),
        F.count(talk).alias("talks"),
        F.max(talk).alias("longest"),
        F.sum(F.col("first_call").cast("int")).alias("first_callers"),
        F.max(F.col("caller").isNull().cast("int")).alias("withheld"),
        F.hll_sketch_agg("caller", F.lit(bits)).alias("sketch"),
    )


def report_of_days(days: DataFrame, unit: str, start: Day = None, stop: Day = None) -> DataFrame:
    """The period report with estimated callers, from rows of day_measures.

    Days of several tables or refreshes may be given together, several rows for a day too.
    """
    if unit not in UNITS:
        raise ValueError(f"no such unit of a report: {unit}")
    keys = period_keys(unit)
    bounds = [F.min("call_date").alias("first_date"), F.max("call_date").alias("last_date")]
    sums = ["calls", "calls_ok", "calls_lt_1min", "talk", "talks", "first_callers"]
    known = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    found = in_period(days, start, stop).withColumns(keys).groupBy(*keys).agg(
        *(bounds if unit != "day" else []),
        *[F.sum(name).alias(name) for name in sums],
        rounded_minutes(F.max("longest")).alias("max_minutes"),
        (known + F.max("withheld")).alias("callers"),
    )
    dates = ["first_date", "last_date"]
    if unit == "day":
        found = found.withColumn("weekday", F.date_format("call_date", "E"))
        dates = ["weekday"]
    mean = rounded_minutes(F.try_divide(F.col("talk").cast("double"), F.col("talks")))
    return found.select(
        *keys,
        *dates,
        "calls",
        "calls_ok",
        "calls_lt_1min",
        mean.alias("mean_minutes"),
        "max_minutes",
        "callers",
        F.round(F.col("calls") / F.col("callers"), 1).alias("calls_per_caller"),
        "first_callers",
    )
