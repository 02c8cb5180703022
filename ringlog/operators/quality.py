"""Duplicates, coverage and spread of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlog.functions.calendar import Day, in_period
from ringlog.operators.first_call import mark_first_calls
from ringlog.operators.groups import with_group_stats

CALL = ["caller", "call_date", "time_s"]


# Duplicates


def with_multiplicity(calls: DataFrame) -> DataFrame:
    """How many calls share caller, date and time, on every call."""
    return with_group_stats(calls, CALL, F.count(F.lit(1)).alias("n")).withColumn(
        "is_dup", F.col("n") > 1
    )


def multiplicities(calls: DataFrame) -> DataFrame:
    """The same, one row per caller, date and time."""
    return calls.groupBy(*CALL).agg(F.count(F.lit(1)).alias("n"))


def duplicates_by_year(calls: DataFrame) -> DataFrame:
    """Calls per year and multiplicity."""
    return (
        multiplicities(calls)
        .groupBy(F.year("call_date").alias("year"), F.col("n").alias("multiplicity"))
        .agg(F.sum("n").alias("rows"))
    )


def duplicate_pairs(calls: DataFrame) -> DataFrame:
    """Half of the rows in pairs, and half of all repeated rows."""
    n = F.col("n")
    zero = F.lit(0).cast("bigint")
    return multiplicities(calls).agg(
        (F.coalesce(F.sum(F.when(n == 2, n)), zero) / 2).alias("pairs"),
        (F.coalesce(F.sum(F.when(n > 1, n)), zero) / 2).alias("repeated_halved"),
    )


def duplicate_groups(calls: DataFrame) -> DataFrame:
    """Caller, date and time that occur more than once."""
    return multiplicities(calls).filter("n > 1")


def worst_first(groups: DataFrame) -> DataFrame:
    """O3"""
    return groups.orderBy(F.desc("n"), F.desc("call_date"))


def compare_duplicates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Number of duplicate groups of each size in two datasets."""

    def sizes(calls: DataFrame, name: str) -> DataFrame:
        return duplicate_groups(calls).groupBy("n").agg(F.count("*").alias(name))

    zero = F.lit(0).cast("bigint")
    return (
        sizes(left, "groups_left")
        .join(sizes(right, "groups_right"), "n", "full")
        .select(
            "n",
            F.coalesce("groups_left", zero).alias("groups_left"),
            F.coalesce("groups_right", zero).alias("groups_right"),
        )
    )


def duplicate_crosstab(calls: DataFrame, value: Column, name: str) -> DataFrame:
    """A value against whether the call is a duplicate.

    Calls are counted by call and value before the multiplicity is added up,
    so a group of copies arrives as one row per value it holds.
    """
    counted = calls.withColumn(name, value).groupBy(*CALL, name).agg(F.count("*").alias("k"))
    totals = counted.withColumn("n", F.sum("k").over(Window.partitionBy(*CALL)))
    single = F.when(F.col("n") == 1, F.col("k")).otherwise(0)
    repeated = F.when(F.col("n") > 1, F.col("k")).otherwise(0)
    return totals.groupBy(name).agg(
        F.sum(single).alias("not_dup"), F.sum(repeated).alias("dup")
    )


def crosstab(
    calls: DataFrame, row: str, column: str, values: Sequence[object], prefix: str = ""
) -> DataFrame:
    """Counts of two columns; one result column for each value of the second."""
    return calls.groupBy(row).agg(
        *[
            F.count_if(F.col(column) == value).alias(f"{prefix}{str(value).lower()}")
            for value in values
        ]
    )


def remove_duplicate_calls(calls: DataFrame, strict: bool = False) -> DataFrame:
    """One row for a call that was logged again when it was rerouted.

    id, module and first_call differ between the entries and are dropped;
    first_call is set anew. strict keeps first_call as a column to compare, so
    entries that differ in it both stay.
    """
    if strict:
        return calls.drop("id", "module").distinct()
    distinct = calls.drop("id", "module", "first_call").distinct()
    return mark_first_calls(distinct)


def distinct_check(calls: DataFrame) -> DataFrame:
    """Rows and distinct rows, first_call left out, counted in one pass."""
    rows = calls.drop("first_call")
    return (
        rows.groupBy(*rows.columns)
        .agg(F.count("*").alias("k"))
        .agg(
            F.coalesce(F.sum("k"), F.lit(0).cast("bigint")).alias("rows"),
            F.count("*").alias("distinct_rows"),
        )
        .withColumn("ok", F.col("rows") == F.col("distinct_rows"))
    )


def assert_distinct(calls: DataFrame) -> None:
    found = distinct_check(calls).first()
    if not found.ok:
        repeated = found.rows - found.distinct_rows
        raise ValueError(f"{repeated} of {found.rows} rows repeat another row")


# Coverage


def missing_days(calls: DataFrame) -> DataFrame:
    """Days without a call between the first and the last; none is good."""
    days = calls.select("call_date").distinct()
    wanted = days.agg(
        F.min("call_date").alias("oldest"), F.max("call_date").alias("newest")
    ).select(F.explode(F.sequence("oldest", "newest")).alias("call_date"))
    return wanted.join(days, "call_date", "left_anti")


def assert_all_days(calls: DataFrame) -> None:
    """Fails with all missing days; the calendar bounds how many there can be."""
    missing = [str(row.call_date) for row in missing_days(calls).orderBy("call_date").collect()]
    if missing:
        raise ValueError("no call on " + ", ".join(missing))


def record_count(calls: DataFrame, start: Day = None, stop: Day = None) -> DataFrame:
    """S7"""
    return in_period(calls, start, stop).agg(F.count("*").alias("n"))


def calls_per_day(calls: DataFrame) -> DataFrame:
    """A28"""
    return calls.groupBy("call_date").agg(F.count("*").alias("n"))


# Spread


def _with_fences(counts: DataFrame) -> DataFrame:
    """Days, call_date and n, with the quartiles and fences of their year.

    A year has at most 366 days, so quartiles are exact and the years are
    broadcast.
    """
    days = counts.withColumn("year", F.year("call_date"))
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    years = days.groupBy("year").agg(F.percentile("n", quartiles).alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    years = years.select(
        "year",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[0] - reach).alias("low_fence"),
        (F.col("q")[2] + reach).alias("high_fence"),
    )
    return days.join(F.broadcast(years), "year")


def daily_box_stats(calls: DataFrame) -> DataFrame:
    """Box and whiskers of the daily calls of each year."""
    return box_of_counts(calls_per_day(calls))


def box_of_counts(counts: DataFrame) -> DataFrame:
    """A29 of days that are counted already, one row (call_date, n) for each."""
    inside = F.when(F.col("n").between(F.col("low_fence"), F.col("high_fence")), F.col("n"))
    return (
        _with_fences(counts)
        .groupBy("year", "q1", "median", "q3")
        .agg(
            F.min(inside).alias("low_whisker"),
            F.max(inside).alias("high_whisker"),
            (F.count("*") - F.count(inside)).alias("outliers"),
        )
    )


def daily_outliers(calls: DataFrame) -> DataFrame:
    """Days beyond the whiskers."""
    return (
        _with_fences(calls_per_day(calls))
        .filter(~F.col("n").between(F.col("low_fence"), F.col("high_fence")))
        .select("year", "call_date", "n")
    )


def six_numbers(table: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, median, mean and maximum of a whole number.

    Values are counted first, so the last step sees each value once. Meant for
    counts and durations, which take few values.
    """
    values = table.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("frequency")
    )
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    weighted = F.sum(F.col(column) * F.col("frequency")) / F.sum("frequency")
    return values.agg(
        F.min(column).cast("double").alias("minimum"),
        F.percentile(column, quartiles, F.col("frequency")).alias("q"),
        weighted.alias("mean"),
        F.max(column).cast("double").alias("maximum"),
    ).select(
        "minimum",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        "mean",
        F.col("q")[2].alias("q3"),
        "maximum",
    )
