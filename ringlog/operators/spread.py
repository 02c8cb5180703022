"""A23, A29, A30 from rows by day that add up, so that quantiles of a period read no call.

Quantiles do not add up, so a day keeps sketches (KLL) of the attempts of its callers and
of its talk times, and the sketches of a period are merged. A caller's attempts are those
of one day, so days share none. Counts, sums, least and greatest values are exact; the
rank of a quantile is off by at most RANK_ERROR with a confidence of 99 %, and by nothing
where a period has few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlog.functions import in_period
from ringlog.functions.calendar import Day
from ringlog.operators.attempts import caller_days
from ringlog.operators.period import period_keys
from ringlog.operators.quality import box_of_counts

#: Size of a sketch, and the error of ranks that goes with it.
SKETCH_SIZE = 400
RANK_ERROR = 0.0104


def day_spread(calls: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """One row for each day with a call: sketches of attempts and talk times, and exact measures.

    Withheld numbers (null) are one caller; calls without a date have no day.
    """
    dated = calls.filter(F.col("call_date").isNotNull())
    callers = caller_days(dated).groupBy("call_date").agg(
        F.sum("attempts").alias("n"),
        F.kll_sketch_agg_bigint(F.col("attempts").cast("bigint"), F.lit(size)).alias("attempts"),
    )
    talk = F.when(F.col("success"), F.col("duration_out")).cast("bigint")
    talks = dated.select("call_date", talk.alias("talk")).filter("talk is not null")
    talks = talks.groupBy("call_date").agg(
        F.count("*").alias("talks"),
        F.sum("talk").alias("talk_sum"),
        F.min("talk").alias("talk_least"),
        F.max("talk").alias("talk_most"),
        F.kll_sketch_agg_bigint("talk", F.lit(size)).alias("talk"),
    )
    return callers.join(talks, "call_date", "left")


def _merged(
    days: DataFrame, sketch: str, unit: str | None, more: Sequence[Column] = ()
) -> tuple[DataFrame, list[str]]:
    """The sketches of each period as one, of days that have one; without a unit of all days."""
    keys = period_keys(unit) if unit else {}
    found = days.filter(F.col(sketch).isNotNull()).withColumns(keys).groupBy(*keys)
    return found.agg(F.kll_merge_agg_bigint(sketch).alias("sketch"), *more), list(keys)


def _quantile(rank: float) -> Column:
    """Without a day there is no sketch to ask."""
    asked = F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(rank)))
    return F.when(F.kll_sketch_get_n_bigint("sketch") > 0, asked).cast("double")


def attempt_quantiles(
    days: DataFrame,
    unit: str | None = None,
    probabilities: Sequence[float] = (0.5, 0.75, 0.9),
    start: Day = None,
    stop: Day = None,
) -> DataFrame:
    """Estimated quantiles of attempts per caller-day, columns p50, p75, p90."""
    found, keys = _merged(in_period(days, start, stop), "attempts", unit)
    return found.select(*keys, *[_quantile(p).alias(f"p{round(100 * p)}") for p in probabilities])


def six_numbers(
    days: DataFrame, unit: str | None = None, start: Day = None, stop: Day = None
) -> DataFrame:
    """Least, mean and greatest talk time of successful calls, and estimated quartiles."""
    exact = [
        F.min("talk_least").cast("double").alias("minimum"),
        (F.sum("talk_sum") / F.sum("talks")).alias("mean"),
        F.max("talk_most").cast("double").alias("maximum"),
    ]
    found, keys = _merged(in_period(days, start, stop), "talk", unit, exact)
    return found.select(
        *keys,
        "minimum",
        _quantile(0.25).alias("q1"),
        _quantile(0.5).alias("median"),
        "mean",
        _quantile(0.75).alias("q3"),
        "maximum",
    )


def box_stats(days: DataFrame) -> DataFrame:
    """Box and whiskers of the daily calls of each year, exact.

    Days of several tables may be given together, several rows for a day too.
    """
    return box_of_counts(days.groupBy("call_date").agg(F.sum("n").alias("n")))
