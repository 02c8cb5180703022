"""Call tables made from the given orders, customer, nation and event tables.

A call is an order, its caller the customer; a customer's nation is the area
of a landline number. Another set of calls is made from the events, for their
time of day. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlog.functions import clock_text, is_landline
from ringlog.schema import STATES


def _padded(value: Column, digits: int) -> Column:
    """Leading zeros up to so many digits; longer values stay whole."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One area per nation, its codes of all four lengths."""
    k = F.col("n_nationkey")
    names = F.array(*[F.lit(name) for name, _ in STATES])
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        k,
        F.when(k % 4 == 0, F.concat(F.lit("00493"), k.cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("00492"), _padded(k, 2)))
        .when(k % 4 == 2, F.concat(F.lit("00496"), _padded(k, 3)))
        .otherwise(F.concat(F.lit("00499"), _padded(k, 4)))
        .alias("area_code"),
        F.col("n_name").alias("area_name"),
        F.when(k < 24, F.get(names, k % 16)).alias("state"),
        F.concat_ws(", ", _padded(k * 397, 5), _padded(k * 397 + 1, 5)).alias("plz"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned calls, callers not hashed, without first_call."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # The two keys are joined on first, and text is made only after that, so
    # that the customer side is small while its size is compared.
    located = orders.join(
        customer.select("c_custkey", "c_nationkey"), orders.o_custkey == customer.c_custkey
    ).join(areas(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    mobile = person % 20 < 9
    return located.select(
        key.cast("string").alias("id"),
        F.col("o_orderdate").cast("date").alias("call_date"),
        (key * 7919 % 86400).cast("int").alias("time_s"),
        F.when(mobile, F.concat(F.lit("004915"), _padded(person, 8)))
        .otherwise(F.concat("area_code", _padded(person, 7)))
        .alias("caller"),
        (key % 1500).cast("int").alias("duration_in"),
        (F.floor("o_totalprice") % 2000).cast("int").alias("duration_out"),
        (F.col("o_orderstatus") != "P").alias("success"),
        *[
            F.when(~mobile, F.col(c)).alias(c)
            for c in ("area_code", "area_name", "state", "plz")
        ],
        F.lit(None).cast("string").alias("module"),
    ).withColumn("is_landline", is_landline(F.col("caller")))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same calls as API records, all text."""
    return calls(spark, sf_dir).select(
        "id",
        F.date_format("call_date", "yyyy-MM-dd").alias("date"),
        clock_text(F.col("time_s")).alias("time"),
        F.lit("0800").alias("service"),
        F.lit("Hotline").alias("service_caption"),
        "caller",
        F.lit("T1").alias("tarif"),
        F.lit("Hotline").alias("modul_name"),
        F.col("duration_in").cast("string").alias("duration_inbound"),
        F.col("duration_out").cast("string").alias("duration_outbound"),
        F.col("success").cast("string").alias("success"),
    )


def rerouted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls, and a second entry for those that are rerouted: the shortest."""
    again = F.col("duration_out") < 40
    entry = F.when(again, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    entries = (
        calls(spark, sf_dir).withColumn("again", again).withColumn("rerouted", F.explode(entry))
    )
    silent = F.when(F.col("again"), F.lit(0))
    return entries.withColumns(
        {
            "id": F.when(F.col("rerouted"), F.concat(F.lit("r"), "id")).otherwise(F.col("id")),
            "module": F.when(F.col("rerouted"), "Routingpunkt Easy").otherwise("Hotline"),
            "success": F.col("success") & ~F.col("again"),
            "duration_in": F.coalesce(silent, "duration_in"),
            "duration_out": F.coalesce(silent, "duration_out"),
        }
    ).drop("again", "rerouted")


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls from events; zero durations and many attempts a day occur."""
    ts = F.col("ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("id"),
        ts.cast("date").alias("call_date"),
        (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int").alias("time_s"),
        F.col("user_id").cast("string").alias("caller"),
        (F.col("event_id") % 3).cast("int").alias("duration_in"),
        F.floor("value").cast("int").alias("duration_out"),
        (F.col("event_type") != "error").alias("success"),
    )
