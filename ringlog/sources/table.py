"""The fact table on disk, partitioned by year or by year and day."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlog.functions import clock_text, in_period
from ringlog.functions.calendar import Day
from ringlog.schema import CALLS, FILE_COLUMNS, PARTITIONS, as_calls
from ringlog.session import exists, read_note, remove_path, write_note
from ringlog.sources.callers import drop_callers, replace_callers

ORDER = ["call_date", "time_s", "caller"]


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """What a table on disk is partitioned by: year, or year and day."""
    found = spark.read.schema(T.StructType([])).parquet(path).columns
    return [name for name in PARTITIONS.names if name in found]


def read_calls(spark: SparkSession, path: str, start: Day = None, stop: Day = None) -> DataFrame:
    """The fact table; a period also selects the partitions to read.

    It has the columns of the fact table whatever its files have, as files that
    were written at different times may lack some. While a replacement is not
    finished, the partitions that it replaces are read from where they are staged, so
    a reader sees the table as it was before or as it will be, and no mixture.
    """
    by = partition_columns(spark, path)
    schema = T.StructType([*CALLS.fields, *[PARTITIONS[name] for name in by]])
    found = in_period(spark.read.schema(schema).parquet(path), start, stop)
    swap = pending(spark, path)
    if swap is None:
        return found
    inner = PARTITIONS[by[-1]]
    old = F.col(inner.name).isin([F.lit(key[len(by) - 1]) for key in sorted(swap.keys)])
    new = in_period(spark.read.schema(schema).parquet(swap.rows), start, stop)
    return found.filter(~old).unionByName(new)


def write_calls(
    calls: DataFrame,
    path: str,
    years: Sequence[int] | None = None,
    format: str = "parquet",
    by_day: bool | None = None,
    observe: Observation | None = None,
) -> None:
    """Write calls by year, sorted by date, time and caller.

    With years only those are written and other years on disk stay as they
    are. Calls without a date, or of a year that is not asked for, are not
    written; an observation counts them (rows_in, rows_without_date,
    rows_of_other_years).

    Rows get the columns and types of the fact table, nulls where they lack one.
    Parquet is also partitioned by day unless by_day is off, so that a refresh
    rewrites days and not a year; exchanged CSV files are by year.

    Rows are shuffled by month or day and rebalanced: adaptive execution cuts
    what is large into files of its advisory size, whether that is a year, a
    day or copies of one call, and joins what is small. Unlike a distribution
    by ranges this takes no extra pass over the calls to sample them. Each
    file is sorted. CSV files have the headings in which such files are
    exchanged.
    """
    by_day = format == "parquet" if by_day is None else by_day
    if format == "parquet":
        spark = calls.sparkSession
        # What is pending is part of a table of which only some years are written.
        finish_replacement(spark, path) if years is not None else drop_replacement(spark, path)
        drop_callers(spark, path)
    calls = as_calls(calls).withColumn("year", F.year("call_date"))
    wanted = F.col("year").isNotNull()
    if years is not None:
        wanted = wanted & F.col("year").isin([int(year) for year in years])
    if observe is not None:
        calls = calls.observe(
            observe,
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(F.col("year").isNull()).alias("rows_without_date"),
            F.count_if(F.col("year").isNotNull() & ~wanted).alias("rows_of_other_years"),
        )
    rows = calls.filter(wanted)
    if by_day:
        rows = rows.withColumn("day", F.col("call_date")).hint("rebalance", "year", "day")
    else:
        rows = rows.withColumn("month", F.month("call_date")).hint("rebalance", "year", "month")
        rows = rows.drop("month", "day")
    rows = rows.sortWithinPartitions("year", *ORDER)
    if format == "csv":
        names = {column: heading for heading, column in FILE_COLUMNS.items()}
        rows = rows.withColumn("time_s", clock_text(F.col("time_s"))).withColumnsRenamed(
            {c: names[c] for c in rows.columns if c in names}
        )
    old_days: set[dt.date] = set()
    if by_day and years is not None:
        # Of a year that is written, days without a call any more are emptied after.
        new_years = [row.year for row in rows.select("year").distinct().collect()]
        old_days = _days(calls.sparkSession, path, new_years)
    writer = (
        rows.write.partitionBy(*PARTITIONS.names[: 2 if by_day else 1])
        .mode("overwrite")
        .option("partitionOverwriteMode", "static" if years is None else "dynamic")
    )
    if format == "csv":
        writer.option("header", "true").option("escape", '"').option("nullValue", "NA").csv(path)
    else:
        writer.parquet(path)
    if old_days:
        new_days = rows.filter(F.col("day").isin(sorted(old_days))).select("day").distinct()
        gone = old_days - {row.day for row in new_days.collect()}
        _empty(calls.sparkSession, path, {(day.year, day) for day in gone})


def _days(spark: SparkSession, path: str, years: Sequence[int]) -> set[dt.date]:
    """The days of some years that a table on disk has, none if there is no table."""
    if not exists(spark, path):
        return set()
    days = read_calls(spark, path).filter(F.col("year").isin([int(year) for year in years]))
    return {row.day for row in days.select("day").distinct().collect()}


def _empty(spark: SparkSession, path: str, keys: set[tuple]) -> None:
    """Leave partitions without rows, as an overwrite by partitions keeps those it has none for."""
    nothing = spark.createDataFrame([], CALLS)
    for key in sorted(keys):
        folder = "/".join(
            f"{name}={value}" for name, value in zip(PARTITIONS.names, key, strict=False)
        )
        nothing.write.mode("overwrite").parquet(f"{path}/{folder}")
    if keys:
        spark.catalog.refreshByPath(path)


def replace_partitions(
    spark: SparkSession, staged: str, path: str, emptied: Iterable[dt.date] = ()
) -> None:
    """R2: put the partitions of a staged table in the place of those on disk.

    emptied are days whose calls are all gone. Their partitions are emptied where
    the staged table has none for them, after the others are written, so a reader
    in between sees a call twice rather than not at all. Older years go first. Can
    be repeated as long as the staged table is there, and has to be if it fails.
    """
    by = partition_columns(spark, staged)
    rows = read_calls(spark, staged)
    present = {tuple(row) for row in rows.select(*by).distinct().collect()}
    for year in sorted({key[0] for key in present}):
        one = rows.filter(F.col("year") == year).sortWithinPartitions("year", *ORDER)
        one.write.partitionBy(*by).mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(path)
    _empty(spark, path, {(day.year, day)[: len(by)] for day in emptied} - present)
    spark.catalog.refreshByPath(path)


def swap_folder(path: str) -> str:
    """Where partitions are staged that are to replace some of a table."""
    return f"{path.rstrip('/')}-replacing"


def new_stage(path: str) -> str:
    """A folder of its own for the rows and the callers of one replacement."""
    return f"{swap_folder(path)}/{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Swap:
    """A replacement that is to be: the staged folder, its first day, and the partitions replaced."""

    folder: str
    start: dt.date
    keys: frozenset[tuple]

    @property
    def rows(self) -> str:
        return f"{self.folder}/table"

    @property
    def callers(self) -> str:
        return f"{self.folder}/callers"


def _list_path(path: str) -> str:
    return f"{swap_folder(path)}/list.json"


def pending(spark: SparkSession, path: str) -> Swap | None:
    """The replacement of partitions of a table that has begun and not ended, if there is one."""
    text = read_note(spark, _list_path(path))
    if text is None:
        return None
    said = json.loads(text)
    keys = [(year, *map(dt.date.fromisoformat, days)) for year, *days in said["keys"]]
    folder = f"{swap_folder(path)}/{said['folder']}"
    return Swap(folder, dt.date.fromisoformat(said["start"]), frozenset(keys))


def begin_replacement(
    spark: SparkSession, folder: str, path: str, start: dt.date, emptied: Iterable[dt.date] = ()
) -> None:
    """R2: decide to replace partitions by those staged in a folder of new_stage.

    The list of the partitions, a small file put there by a rename, is the decision.
    From then on reads take them from the folder, and whoever comes next finishes what
    is left to do; before, the table is as it was.
    """
    by = partition_columns(spark, f"{folder}/table")
    rows = read_calls(spark, f"{folder}/table")
    present = {tuple(row) for row in rows.select(*by).distinct().collect()}
    keys = present | {(day.year, day)[: len(by)] for day in emptied}
    said = {
        "folder": folder.rsplit("/", 1)[1],
        "start": start.isoformat(),
        "keys": [[year, *(day.isoformat() for day in days)] for year, *days in sorted(keys)],
    }
    write_note(spark, _list_path(path), json.dumps(said))


def finish_replacement(spark: SparkSession, path: str) -> bool:
    """R2: put what is pending in its place; whether there was anything.

    Every step can be repeated, so a run that breaks off is finished by the next. What
    was staged and never decided on is removed. A table has one writer at a time.
    """
    swap = pending(spark, path)
    if swap is not None:
        days = [key[1] if len(key) > 1 else dt.date(key[0], 1, 1) for key in swap.keys]
        replace_partitions(spark, swap.rows, path, days)
        if exists(spark, swap.callers):
            replace_callers(spark, swap.callers, path, swap.start)
    drop_replacement(spark, path)
    return swap is not None


def drop_replacement(spark: SparkSession, path: str) -> None:
    """Remove all that is staged beside a table, the list first."""
    for folder in (_list_path(path), swap_folder(path)):
        if exists(spark, folder):
            remove_path(spark, folder)
