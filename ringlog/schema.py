"""Column names, types and the fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The cleaned fact table. time_s is seconds since midnight.
CALLS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("call_date", T.DateType()),
        T.StructField("time_s", T.IntegerType()),
        T.StructField("caller", T.StringType()),
        T.StructField("duration_in", T.IntegerType()),
        T.StructField("duration_out", T.IntegerType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("area_code", T.StringType()),
        T.StructField("area_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("plz", T.StringType()),
        T.StructField("first_call", T.BooleanType()),
        T.StructField("is_landline", T.BooleanType()),
        T.StructField("module", T.StringType()),
    ]
)

# How the fact table is partitioned on disk.
PARTITIONS = T.StructType(
    [T.StructField("year", T.IntegerType()), T.StructField("day", T.DateType())]
)

# Heading in the exchanged files and API records -> column here.
FILE_COLUMNS = {
    "id": "id",
    "date": "call_date",
    "time": "time_s",
    "caller": "caller",
    "duration_inbound": "duration_in",
    "duration_outbound": "duration_out",
    "success": "success",
    "Ortsnetzkennzahl": "area_code",
    "Ortsnetzname": "area_name",
    "Bundesland": "state",
    "PLZ": "plz",
    "firstcall": "first_call",
    "is_landline": "is_landline",
    "modul_name": "module",
}

# Fields of one API record, all read as text.
API_FIELDS = [
    "id",
    "date",
    "time",
    "service",
    "service_caption",
    "caller",
    "tarif",
    "modul_name",
    "duration_inbound",
    "duration_outbound",
    "success",
]

# Provider columns that cleaning drops.
REDUNDANT = ["service", "service_caption", "tarif"]

# The legacy single file is read by position.
LEGACY_FIELDS = [
    "date",
    "time",
    "caller",
    "duration_inbound",
    "duration_outbound",
    "success",
    "landline",
    "Ortsnetzkennzahl",
    "Ortsnetzname",
    "Bundesland",
    "PLZ",
    "firstcall",
]

AREA_FIELDS = {
    "Ortsnetzkennzahl": "area_code",
    "Ortsnetzname": "area_name",
    "Bundesland": "state",
    "PLZ": "plz",
}

# The sixteen states and their short codes.
STATES = [
    ("Baden-Württemberg", "BW"),
    ("Bayern", "BY"),
    ("Berlin", "BE"),
    ("Brandenburg", "BB"),
    ("Bremen", "HB"),
    ("Hamburg", "HH"),
    ("Hessen", "HE"),
    ("Mecklenburg-Vorpommern", "MV"),
    ("Niedersachsen", "NI"),
    ("Nordrhein-Westfalen", "NW"),
    ("Rheinland-Pfalz", "RP"),
    ("Saarland", "SL"),
    ("Sachsen", "SN"),
    ("Sachsen-Anhalt", "ST"),
    ("Schleswig-Holstein", "SH"),
    ("Thüringen", "TH"),
]

MOBILE = "Mobil"
UNKNOWN = "Unbk."
ALL_STATES = "Alle"


def as_calls(rows: DataFrame) -> DataFrame:
    """The columns of the fact table in their order and types; missing ones are null."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CALLS
        ]
    )


def state_table(spark: SparkSession) -> DataFrame:
    """The sixteen states as a table of (state, state_code).

    Written as values in SQL, so that its size is known to the optimizer.
    """
    rows = ", ".join(f"('{state}', '{code}')" for state, code in STATES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(state, state_code)")


def text_or_null(value: Column) -> Column:
    """Cells that are empty or say NA hold no value."""
    trimmed = F.trim(value)
    return F.when(~trimmed.isin("", "NA"), trimmed)
