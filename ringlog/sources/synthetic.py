"""Made-up calls of any number."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ringlog.operators.geo import area_lookup

# Fixed values of the made-up data.
CALLS = 800_000
CALLERS = 30_000
FIRST_DAY = dt.date(2020, 1, 1)
LAST_DAY = dt.date(2025, 8, 8)
LONGEST = 2000
SUCCESS_PERCENT = 61
LANDLINE_PERCENT = 55
FIRST_CALL_PERCENT = 61


def synthetic_calls(
    numbers: DataFrame, areas: DataFrame, seed: int = 5432, callers: int = CALLERS
) -> DataFrame:
    """One call per row of numbers (column n), joined to its area.

    All values come from a digest of seed and n, not from a random stream: a
    task that is run again makes the same calls. first_call is random too, as
    the other columns are; use mark_first_calls to set it right.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("n").cast("string")), 256)

    def draw(i: int, below: Column | int) -> Column:
        """The i-th number drawn from 0 up to below, from seven digits of the digest."""
        part = F.conv(F.substring("digest", 1 + 7 * i, 7), 16, 10).cast("bigint")
        return part % below

    days = (LAST_DAY - FIRST_DAY).days + 1
    # One row per code, of which there is a bounded number, see operators.geo.
    numbered = area_lookup(areas).select(
        "area_code",
        (F.row_number().over(Window.orderBy("area_code")) - 1).cast("bigint").alias("area_no"),
        "area.*",
    )
    count = numbered.count()
    return (
        numbers.select("n", digest.alias("digest"))
        .select(
            F.col("n").cast("string").alias("id"),
            F.date_add(F.lit(FIRST_DAY), draw(0, days).cast("int")).alias("call_date"),
            draw(1, 86400).cast("int").alias("time_s"),
            draw(2, callers).cast("string").alias("caller"),
            draw(3, LONGEST).cast("int").alias("duration_in"),
            draw(4, LONGEST).cast("int").alias("duration_out"),
            (draw(5, 100) < SUCCESS_PERCENT).alias("success"),
            (draw(6, 100) < LANDLINE_PERCENT).alias("is_landline"),
            (draw(7, 100) < FIRST_CALL_PERCENT).alias("first_call"),
            draw(8, count).alias("area_no"),
        )
        .join(F.broadcast(numbered), "area_no", "inner")
        .drop("area_no")
    )


def synthetic_table(spark: SparkSession, areas: DataFrame, calls: int = CALLS) -> DataFrame:
    return synthetic_calls(spark.range(calls).withColumnRenamed("id", "n"), areas)
