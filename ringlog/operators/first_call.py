"""The first call of every caller."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlog.operators.groups import collapse_copies, join_back, unfold_copies


def _moment() -> Column:
    """Date and time as one number; without a date or time after all others."""
    day = F.unix_date(F.coalesce("call_date", F.lit(dt.date(9999, 12, 31)))).cast("bigint")
    return day * 86401 + F.coalesce("time_s", F.lit(86400))


def mark_first_calls(calls: DataFrame, known_callers: DataFrame | None = None) -> DataFrame:
    """Set first_call: true on one call of each caller, the first, else false.

    Calls are ordered by date, time and id, where a longer id is larger, as for
    numbers; then, or without an id, by all other columns, nulls first. Of rows
    that are equal in all columns one is the first call. Withheld numbers (null)
    are one caller. Give it the whole history, before any filter on dates.

    With known_callers (distinct, column caller) the calls continue a history
    in which those have called before, and only the others get a first call.

    The first moment of a caller is one number, combined before the shuffle and
    joined back from the side of the calls, so no task gets all calls of one caller.
    What decides among calls at that moment is compared for these only: they are
    collapsed to distinct rows, and the least row of a caller is joined back on all
    its columns. Where it is there several times, its copies are written anew.
    """
    columns = [c for c in calls.columns if c != "first_call"]
    timed = calls.select(*columns, _moment().alias("moment"))
    firsts = timed.groupBy("caller").agg(F.min("moment").alias("moment"))
    if known_callers is not None:
        firsts = join_back(firsts, known_callers.select("caller"), ["caller"], "left_anti")
    earliest = join_back(timed, firsts, ["caller", "moment"], "left_semi").select(*columns)
    first = _first_rows(earliest).withColumn("first_call", F.lit(True))
    marked = join_back(timed.select(*columns), first, columns)
    single = marked.filter(F.coalesce(F.col("copies") == 1, F.lit(True))).select(
        *columns, F.coalesce("first_call", F.lit(False)).alias("first_call")
    )
    repeated = unfold_copies(first.filter("copies > 1").select(*columns, "copies"))
    return single.union(repeated.select(*columns, (F.col("copy_no") == 0).alias("first_call")))


def _first_rows(calls: DataFrame) -> DataFrame:
    """Of calls at the first moment of their callers, the least row of each with its copies."""
    columns = calls.columns
    order = [c for c in ("id", *columns) if c in columns and c != "caller"]
    order = list(dict.fromkeys(order))
    length = F.length("id") if "id" in columns else F.lit(0)
    rows = collapse_copies(calls).withColumn("id_length", length)
    least = rows.groupBy("caller").agg(F.min(F.struct("id_length", *order, "copies")).alias("row"))
    return least.select("caller", *[F.col(f"row.{c}").alias(c) for c in order], "row.copies").select(
        *columns, "copies"
    )
