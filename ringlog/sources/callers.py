"""The callers of a table and the day of their first call, kept beside it.

A refresh from a day on has to know who has called before. The index answers that
from one row for each caller, by the day of the first call: no call of an earlier day
is read, and the days that a refresh replaces are whole partitions of the index too.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlog.session import exists, remove_path, subfolders

INDEX = T.StructType(
    [T.StructField("caller", T.StringType()), T.StructField("first_day", T.DateType())]
)


def callers_path(path: str) -> str:
    """Where the index of a table is."""
    return f"{path.rstrip('/')}-callers"


def first_days(calls: DataFrame) -> DataFrame:
    """(caller, first_day) of calls whose first calls are marked; withheld numbers are one caller."""
    return calls.filter("first_call").select("caller", F.col("call_date").alias("first_day"))


def write_callers(calls: DataFrame, folder: str, mode: str = "error") -> None:
    """The index of these calls, in one file or more for each day."""
    rows = first_days(calls).filter(F.col("first_day").isNotNull())
    rows = rows.withColumn("day", F.col("first_day")).hint("rebalance", "day")
    rows.drop("first_day").withColumnRenamed("day", "first_day").write.partitionBy(
        "first_day"
    ).mode(mode).parquet(folder)


def has_callers(spark: SparkSession, path: str) -> bool:
    """Whether a table's index is whole: its writer leaves a mark at the end."""
    return exists(spark, f"{callers_path(path)}/_SUCCESS")


def callers_before(spark: SparkSession, path: str, start: dt.date) -> DataFrame:
    """Each caller who has called before a day, from the partitions of earlier days."""
    found = spark.read.schema(INDEX).parquet(callers_path(path))
    return found.filter(F.col("first_day") < F.lit(start)).select("caller")


def drop_callers(spark: SparkSession, path: str) -> None:
    """Forget the index of a table that is written otherwise; the next refresh makes it anew."""
    if exists(spark, callers_path(path)):
        remove_path(spark, callers_path(path))


def replace_callers(spark: SparkSession, staged: str, path: str, start: dt.date) -> None:
    """Put staged days in the place of all days of the index from start on. Can be repeated."""
    index = callers_path(path)
    for name in subfolders(spark, index):
        if name.startswith("first_day=") and name.partition("=")[2] >= start.isoformat():
            remove_path(spark, f"{index}/{name}")
    spark.catalog.refreshByPath(index)
    rows = spark.read.schema(INDEX).parquet(staged).hint("rebalance", "first_day")
    rows.write.partitionBy("first_day").mode("append").parquet(index)
    spark.catalog.refreshByPath(index)
