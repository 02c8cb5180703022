"""Put fetched calls into the table, whole days or call by call."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlog.functions.calendar import Day, as_day, in_period
from ringlog.operators.first_call import mark_first_calls
from ringlog.operators.groups import join_back
from ringlog.session import work_path

Range = tuple[Day, Day]


def last_day(calls: DataFrame) -> dt.date | None:
    """The day a refresh starts from: it may be half loaded."""
    return calls.agg(F.max("call_date")).first()[0]


def in_range(covered: Range):
    """Whether a call is of the days that were fetched as a whole."""
    start, stop = (as_day(day) for day in covered)
    day = F.col("call_date")
    rules = [day >= F.lit(start)] if start else []
    rules += [day <= F.lit(stop)] if stop else []
    found = F.lit(True)
    for rule in rules:
        found = found & rule
    return F.coalesce(found, F.lit(False))


def merged(stored: DataFrame, fetched: DataFrame, covered: Range | None = None) -> DataFrame:
    """Stored calls with the fetched ones in their place, without first_call.

    Stored calls of the covered days go, as the fetched are all of these days. On
    other days a stored call goes if it was fetched too: known by its id, or, if it
    has none, by all other columns. All others stay.
    """
    stored = stored.drop("first_call")
    fetched = fetched.drop("first_call")
    if covered is not None:
        stored = stored.filter(~in_range(covered))
    columns = [c for c in stored.columns if c in fetched.columns]
    row = F.to_json(F.struct(*columns))
    known = F.concat(F.lit("id "), F.col("id")) if "id" in columns else F.lit(None).cast("string")
    name = F.coalesce(known, row).alias("name")
    again = fetched.select(name).distinct()
    kept = join_back(stored.withColumn("name", name), again, ["name"], "left_anti").drop("name")
    return kept.unionByName(fetched, allowMissingColumns=True)


def known_before(current: DataFrame, calls: DataFrame, start: Day) -> DataFrame:
    """Those callers of `calls` who have called before a day.

    Of the history only the column of callers is read, and of that only those who
    call again are looked at: the optimizer moves the semi-join before the distinct
    where these callers are few enough to broadcast.
    """
    history = current.filter(F.col("call_date") < F.lit(as_day(start))).select("caller").distinct()
    return known_among(history, calls)


def known_among(history: DataFrame, calls: DataFrame) -> DataFrame:
    """Those of a table of callers, each there once, who are callers of `calls`."""
    return join_back(history, calls.select("caller").distinct(), ["caller"], "left_semi")


def new_rows(
    current: DataFrame,
    fetched: DataFrame,
    start: Day,
    covered: Range | None = None,
    folder: str | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """All calls from a day on as they are after the refresh, with first_call.

    start is the first day that has a fetched call or is covered. Flags of calls
    before it hold, as nothing earlier changes; from there on they are set anew.
    The calls of these days are written to a folder (one in the shared work folder
    if none is given), as they are used several times. earlier are the callers before
    start, each once; without it they are taken from the calls of current.
    """
    later = current.filter(F.col("call_date") >= F.lit(as_day(start)))
    rows = merged(later, fetched, covered)
    folder = folder or work_path(current.sparkSession, "refresh")
    rows.write.parquet(folder)
    both = current.sparkSession.read.schema(rows.schema).parquet(folder)
    if earlier is None:
        return mark_first_calls(both, known_before(current, both, start))
    return mark_first_calls(both, known_among(earlier, both))


def refresh_calls(
    current: DataFrame,
    fetched: DataFrame,
    start: Day = None,
    stop: Day = None,
    recompute: bool = False,
) -> DataFrame:
    """Current with all calls from its last day on replaced by the fetched.

    fetched is cleaned, and holds all calls from start (the last day of current) to
    stop. If it is empty the table stays as it is. With recompute all flags are set
    anew from the whole history, for tables whose stored flags are not to be
    trusted.
    """
    start = start or last_day(current)
    if start is None:
        return mark_first_calls(in_period(fetched, None, stop))
    wanted = in_period(fetched, start, stop)
    if wanted.isEmpty():
        return current
    kept = current.filter(F.col("call_date") < F.lit(as_day(start)))
    if recompute:
        both = kept.drop("first_call").unionByName(wanted, allowMissingColumns=True)
        return mark_first_calls(both)
    new = new_rows(current, wanted, start, (start, None))
    return kept.unionByName(new, allowMissingColumns=True)
