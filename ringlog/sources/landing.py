"""API responses that were put into a landing folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ringlog.functions.calendar import Day, as_day, parse_date
from ringlog.schema import API_FIELDS
from ringlog.session import exists

RECORD = T.StructType([T.StructField(field, T.StringType()) for field in API_FIELDS])
ENVELOPE = T.StructType(
    [
        T.StructField(
            "response", T.StructType([T.StructField("data", T.ArrayType(RECORD))])
        )
    ]
)

# Rows a single request may return, and rows aimed at.
REQUEST_LIMIT = 100_000
REQUEST_TARGET = 70_000


def unwrap(envelopes: DataFrame) -> DataFrame:
    """The records of responses, one row each."""
    return envelopes.select(F.explode("response.data").alias("r")).select("r.*")


def records_between(records: DataFrame, start: Day = None, stop: Day = None) -> DataFrame:
    """The records a request for these days would have returned."""
    day = parse_date(F.col("date"))
    if start is not None:
        records = records.filter(day >= F.lit(as_day(start)))
    if stop is not None:
        records = records.filter(day <= F.lit(as_day(stop)))
    return records


def read_responses(
    spark: SparkSession,
    path: str,
    start: Day = None,
    stop: Day = None,
    multi_line: bool = False,
    index: str | None = None,
) -> DataFrame:
    """Records of the responses in a folder, as text; none is a valid result.

    A file that is no response fails the job, rather than to count for none. With the
    index of index_responses, only files that can hold records of these days are opened:
    those whose days meet the range, and those that are not, or as they are not, in it.
    """
    reader = _reader(spark, multi_line)
    if index is None or (start is None and stop is None):
        return records_between(unwrap(reader.json(path)), start, stop)
    files = _files(spark, path).join(_index(spark, index), FILE, "left")
    apart = F.lit(False)
    if start is not None:
        apart = apart | F.coalesce(F.col("last") < F.lit(as_day(start)), F.lit(True))
    if stop is not None:
        apart = apart | F.coalesce(F.col("first") > F.lit(as_day(stop)), F.lit(True))
    chosen = files.filter(F.col("known").isNull() | ~apart).select("path").distinct()
    # Names of files, which the reader's own list of files holds in any case.
    names = sorted(row.path for row in chosen.toLocalIterator())
    if not names:
        return spark.createDataFrame([], RECORD)
    return records_between(unwrap(reader.json([_as_name(name) for name in names])), start, stop)


#: What a file is known by: one that is written anew is another.
FILE = ["file", "size", "modified"]
INDEX = "file string, size bigint, modified timestamp, first date, last date, records bigint"


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return spark.read.schema(ENVELOPE).options(mode="FAILFAST", multiLine=multi_line)


def _as_name(path: str) -> str:
    """A path in which no character is a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _identity() -> list[Column]:
    source = {"file": "file_path", "size": "file_size", "modified": "file_modification_time"}
    return [F.col(f"_metadata.{field}").alias(name) for name, field in source.items()]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, of which none is opened."""
    return spark.read.format("binaryFile").load(path).select(*_identity(), "path")


def _index(spark: SparkSession, index: str) -> DataFrame:
    found = spark.read.schema(INDEX).parquet(index)
    return found.dropDuplicates(FILE).withColumn("known", F.lit(True))


def index_responses(spark: SparkSession, path: str, index: str, multi_line: bool = False) -> int:
    """Put the first and last day of each new response file into an index; how many are new.

    Files that are in the index as they are stay unopened, so each is parsed once for it. A
    file without any date has no days, and no range finds it. A file that is no response
    fails the job, and nothing is added.
    """
    files = _files(spark, path)
    if exists(spark, index):
        files = files.join(_index(spark, index), FILE, "left_anti")
    names = sorted({row.path for row in files.select("path").toLocalIterator()})
    if not names:
        return 0
    rows = _reader(spark, multi_line).json([_as_name(name) for name in names])
    days = F.transform("response.data", lambda record: parse_date(record["date"]))
    parts = rows.select(
        *_identity(),
        F.array_min(days).alias("first"),
        F.array_max(days).alias("last"),
        F.greatest(F.size("response.data"), F.lit(0)).alias("records"),
    )
    found = parts.groupBy(*FILE).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("records").alias("records")
    )
    found.write.mode("append").parquet(index)
    return len(names)


def parse_responses(
    responses: DataFrame, body: str | Column, start: Day = None, stop: Day = None
) -> DataFrame:
    """S6 for response bodies that are held in a text column."""
    body = F.col(body) if isinstance(body, str) else body
    parsed = F.from_json(body, ENVELOPE, {"mode": "FAILFAST"})
    envelopes = responses.select(parsed.alias("e")).select("e.*")
    return records_between(unwrap(envelopes), start, stop)


def chunk_plan(
    calls: DataFrame,
    start: Day = None,
    stop: Day = None,
    limit: int = REQUEST_LIMIT,
    target: int = REQUEST_TARGET,
) -> DataFrame:
    """Ranges of days to request one by one, about target rows each.

    All days from start to stop are covered once, also those without calls. Up
    to limit rows need one range only. A day of more than limit - target rows
    has its own range, so that no range of several days is over the limit;
    oversize marks a single day that is, which days cannot split.

    The running sums go over the days of the calendar, not over calls.
    """
    per_day = calls.filter("call_date is not null").groupBy("call_date").agg(
        F.count("*").alias("n")
    )
    bounds = per_day.agg(F.min("call_date").alias("oldest"), F.max("call_date").alias("newest"))
    first = F.coalesce(F.lit(as_day(start)).cast("date"), F.col("oldest"))
    last = F.coalesce(F.lit(as_day(stop)).cast("date"), F.col("newest"))
    days = bounds.select(F.explode(F.sequence(first, last)).alias("call_date"))
    days = days.join(per_day, "call_date", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    so_far = Window.orderBy("call_date")
    total = F.sum("n").over(Window.partitionBy())
    heavy = F.col("n") > limit - target
    days = days.select(
        "call_date",
        "n",
        (total > limit).alias("split"),
        heavy.alias("heavy"),
        F.count_if(heavy).over(so_far).alias("heavy_so_far"),
        F.floor((F.sum("n").over(so_far) - F.col("n")) / target).alias("step"),
    )
    piece = F.when(F.col("split"), F.struct("heavy_so_far", "heavy", "step"))
    return (
        days.groupBy(piece.alias("piece"))
        .agg(
            F.min("call_date").alias("start"),
            F.max("call_date").alias("stop"),
            F.sum("n").alias("n"),
        )
        .select(
            F.row_number().over(Window.orderBy("start")).alias("chunk"),
            "start",
            "stop",
            "n",
            ((F.col("n") > limit) & (F.col("start") == F.col("stop"))).alias("oversize"),
        )
    )
