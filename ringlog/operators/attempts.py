"""How often callers try on one day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlog.functions import capped, strict_success
from ringlog.operators.groups import with_group_stats

CALLER_DAY = ["caller", "call_date"]


def _counts(strict: bool) -> list[Column]:
    success = strict_success() if strict else F.col("success")
    return [
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(success).alias("successes"),
    ]


def with_attempts(calls: DataFrame, strict: bool = False) -> DataFrame:
    """Attempts and successes of the same caller and day, on every call."""
    return with_group_stats(calls, CALLER_DAY, *_counts(strict))


def caller_days(calls: DataFrame, strict: bool = False) -> DataFrame:
    """U4: the same, one row per caller and day."""
    return (
        calls.groupBy(*CALLER_DAY)
        .agg(*_counts(strict))
        .withColumn("any_success", F.col("successes") > 0)
    )


def attempt_histogram(
    calls: DataFrame, strict: bool = False, only_failed: bool = False, cap: int = 10
) -> DataFrame:
    """Caller-days by number of attempts and whether any got through."""
    days = caller_days(calls, strict)
    if only_failed:
        days = days.filter(~F.col("any_success"))
    return days.groupBy(
        capped(F.col("attempts"), cap).alias("attempts_capped"), "any_success"
    ).agg(F.count("*").alias("n"))


def attempt_quantiles(
    calls: DataFrame,
    probabilities: Sequence[float] = (0.5, 0.75, 0.9),
    strict: bool = False,
    approx: bool = False,
) -> DataFrame:
    """Quantiles of attempts per caller-day, columns p50, p75, p90.

    The caller-days are counted by number of attempts first. n calls make at
    most sqrt(2n) different numbers of attempts, so the last step is small.
    """
    lengths = (
        caller_days(calls, strict).groupBy("attempts").agg(F.count("*").alias("frequency"))
    )
    names = [f"p{round(100 * p)}" for p in probabilities]
    quantiles = [F.lit(float(p)) for p in probabilities]
    if approx:
        found = caller_days(calls, strict).agg(
            F.percentile_approx("attempts", list(map(float, probabilities))).alias("q")
        )
    else:
        found = lengths.agg(
            F.percentile("attempts", F.array(*quantiles), F.col("frequency")).alias("q")
        )
    return found.select(
        *[F.col("q")[i].cast("double").alias(name) for i, name in enumerate(names)]
    )
