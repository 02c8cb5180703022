"""Jobs that write the fact table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ringlog.functions.calendar import Day, as_day
from ringlog.operators.clean import (
    adopt_legacy_column,
    clean_parsed,
    parse_records,
    repair_umlauts,
)
from ringlog.operators.first_call import mark_first_calls
from ringlog.operators.geo import split_area_matches
from ringlog.operators.groups import join_back
from ringlog.operators.refresh import Range, new_rows
from ringlog.schema import PARTITIONS, as_calls
from ringlog.session import exists, remove_path, work_path
from ringlog.sources.callers import callers_before, callers_path, has_callers, write_callers
from ringlog.sources.files import read_annual, read_legacy
from ringlog.sources.table import (
    begin_replacement,
    finish_replacement,
    new_stage,
    partition_columns,
    read_calls,
    write_calls,
)


@contextmanager
def stage(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared work folder for one job, removed when it is done or fails.

    What is written there is pseudonymised already.
    """
    folder = work_path(spark, "stage")
    try:
        yield folder
    finally:
        remove_path(spark, folder)


def staged(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Rows written to a folder and read from there.

    What is parsed, hashed and located is then used several times without
    doing it again, and a lost executor costs no more than a part of that.
    """
    rows.write.mode("overwrite").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def build_table(
    spark: SparkSession,
    calls: DataFrame,
    path: str,
    by_day: bool = True,
    observe: Observation | None = None,
) -> DataFrame:
    """Write a whole history with its first calls set, and read it back."""
    with stage(spark) as folder:
        history = staged(spark, as_calls(calls), f"{folder}/history")
        write_calls(mark_first_calls(history), path, by_day=by_day, observe=observe)
    index_callers(spark, path)
    return read_calls(spark, path)


def index_callers(spark: SparkSession, path: str) -> None:
    """Write the index of a table's callers from its stored flags."""
    write_callers(read_calls(spark, path), callers_path(path), "overwrite")


def import_annual(
    spark: SparkSession,
    folder: str,
    path: str,
    repair: bool = False,
    legacy_column: str | None = None,
    by_day: bool = True,
) -> DataFrame:
    """S1 to S10; on request with P17, and P18 for files that name is_landline otherwise."""
    calls = read_annual(spark, folder)
    if repair:
        calls = repair_umlauts(calls)
    if legacy_column:
        calls = adopt_legacy_column(calls, legacy_column)
    return build_table(spark, calls, path, by_day)


def split_legacy(spark: SparkSession, file: str, path: str, by_day: bool = True) -> DataFrame:
    """The former single file as a table by year and day."""
    return build_table(spark, read_legacy(spark, file), path, by_day)


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the first day that may have changed, and what became of the records."""

    start: dt.date | None
    calls: int
    without_date: int
    without_number: int
    later: int
    set_aside: int


def quarantine_path(path: str) -> str:
    """Where calls that match no area, or several, are set aside."""
    return f"{path.rstrip('/')}-set-aside"


def refresh_table(
    spark: SparkSession,
    path: str,
    records: DataFrame,
    areas: DataFrame,
    as_of: Day,
    covered: Range | None = None,
    on_bad: str = "error",
    salt: str | None = None,
) -> Refresh:
    """Bring the table on disk up to as_of from raw API records.

    covered are the first and the last day of which the records hold all calls, as
    the answer to a request for these days does; stored calls of these days are
    replaced. Without it no stored call goes, and a call that is stored already is
    known by its id. Running it again with the same records changes nothing.

    Records without a date that parses, without a number, or of days after as_of
    are not stored; the result counts each. With on_bad="flag" calls that do not
    match one area are kept out of the table and added to quarantine_path(path).

    Only partitions from the first day on that the records touch are rewritten:
    days, or the years in a table by year. They are written whole beside the table
    first, and a run that fails before that is done leaves the table as it was. Then
    their list is written, which decides: from there on reads see the new state, and
    the next refresh finishes what a broken-off one has left. Who has called before is
    asked of the index of callers, not of earlier calls; a table without one gets it.
    Records are read twice, so that their numbers are never written in plain.
    """
    finish_replacement(spark, path)
    parsed = parse_records(records)
    day = F.col("call_date")
    in_time = F.lit(True) if as_of is None else day <= F.lit(as_day(as_of))
    counts = parsed.agg(
        F.count_if(day.isNull()).alias("without_date"),
        F.count_if(in_time & F.col("caller").isNull()).alias("without_number"),
        F.count_if(~in_time).alias("later"),
    ).first()
    cleaned = clean_parsed(parsed.filter(day.isNotNull() & in_time), areas, on_bad=on_bad, salt=salt)
    set_aside = 0
    with stage(spark) as folder:
        if on_bad == "flag":
            flagged = staged(spark, cleaned, f"{folder}/flagged")
            cleaned, bad = split_area_matches(flagged)
            set_aside = _set_aside(spark, bad, quarantine_path(path))
        fetched = staged(spark, as_calls(cleaned), f"{folder}/fetched")
        found = fetched.agg(F.min("call_date").alias("first"), F.count(F.lit(1)).alias("n")).first()
        start = found["first"]
        if found.n:
            if covered and covered[0]:
                start = min(start, as_day(covered[0]))
            _replace(spark, path, fetched, start, covered, f"{folder}/rows")
    return Refresh(
        start, found.n, counts.without_date, counts.without_number, counts.later, set_aside
    )


def _replace(
    spark: SparkSession,
    path: str,
    fetched: DataFrame,
    start: dt.date,
    covered: Range | None,
    folder: str,
) -> None:
    """Stage what changes from a day on beside the table, decide on it, and put it in place."""
    if not has_callers(spark, path):
        index_callers(spark, path)
    by_day = "day" in partition_columns(spark, path)
    stored = read_calls(spark, path, start)
    earlier = callers_before(spark, path, start)
    changed = new_rows(stored.drop(*PARTITIONS.names), fetched, start, covered, folder, earlier)
    days = [row.call_date for row in stored.select("call_date").distinct().collect()]
    if not by_day:
        kept = read_calls(spark, path, dt.date(start.year, 1, 1), start - dt.timedelta(1))
        changed = kept.drop(*PARTITIONS.names).unionByName(changed)
    beside = new_stage(path)
    try:
        write_calls(changed, f"{beside}/table", by_day=by_day)
        new = read_calls(spark, f"{beside}/table", start)
        write_callers(new, f"{beside}/callers")
        begin_replacement(spark, beside, path, start, days)
    except BaseException:
        remove_path(spark, beside)
        raise
    finish_replacement(spark, path)


def _set_aside(spark: SparkSession, bad: DataFrame, path: str) -> int:
    """Add calls to the quarantine that are not in it yet; how many there are."""
    count = bad.count()
    new = bad
    if exists(spark, path):
        known = spark.read.schema(bad.schema).parquet(path)
        new = join_back(bad, known.distinct(), bad.columns, "left_anti")
    if count:
        new.write.mode("append").parquet(path)
    return count
