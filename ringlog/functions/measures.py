"""Counting rules and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_callers(caller: Column | str = "caller", approx: bool = False) -> Column:
    """Distinct callers; withheld numbers (null) together count as one caller."""
    caller = F.col(caller) if isinstance(caller, str) else caller
    known = F.approx_count_distinct(caller) if approx else F.count_distinct(caller)
    return (known + F.max(caller.isNull().cast("int"))).cast("bigint")


def strict_success() -> Column:
    """Both sides of the call were connected."""
    return (F.col("duration_in") > 0) & (F.col("duration_out") > 0)


def capped(n: Column, cap: int = 10) -> Column:
    """Everything above the cap counts as cap + 1."""
    return F.least(n, F.lit(cap + 1)).cast("bigint")


def fail_share() -> Column:
    """Share of failed calls; a call of unknown outcome is in the whole only."""
    return F.avg(F.when(~F.col("success"), 1.0).otherwise(0.0))


def zero_to_null(n: Column) -> Column:
    """P16"""
    return F.nullif(n, F.lit(0).cast("bigint"))


def null_to_zero(n: Column) -> Column:
    """P16"""
    return F.coalesce(n, F.lit(0).cast("bigint"))


def display_count(n: Column) -> Column:
    """P20: a dot between thousands."""
    return F.translate(F.format_number(n, 0), ",", ".")


def percent_label(share: Column) -> Column:
    """Four significant digits, but no more than eight after the point."""
    value = 100 * share
    size = F.coalesce(F.floor(F.log10(F.abs(F.nullif(value, F.lit(0.0))))), F.lit(0))
    decimals = F.least(F.greatest(F.lit(3) - size, F.lit(0)), F.lit(8))
    shown = F.format_string("%.0f", value)
    for count in range(1, 9):
        text = F.format_string(f"%.{count}f", F.round(value, count))
        shown = F.when(decimals == count, text).otherwise(shown)
    return F.when(share.isNotNull(), F.concat(shown, F.lit("%")))
