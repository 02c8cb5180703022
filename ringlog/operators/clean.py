"""From raw records to the cleaned fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ringlog.functions import is_landline, parse_clock, parse_date, pseudonym
from ringlog.operators.geo import AREA_COLUMNS, attach_area
from ringlog.schema import API_FIELDS, CALLS, FILE_COLUMNS, REDUNDANT, text_or_null


def typed(name: str, value: Column) -> Column:
    """Text as the type its column has in the fact table, or null."""
    value = text_or_null(value)
    if name == "call_date":
        return parse_date(value)
    if name == "time_s":
        return parse_clock(value)
    return value.try_cast(CALLS[name].dataType) if name in CALLS.names else value


def parse_records(raw: DataFrame) -> DataFrame:
    """Rename file or API headings and cast all text by name."""
    columns = []
    for heading in raw.columns:
        name = FILE_COLUMNS.get(heading, heading)
        value = F.col(f"`{heading}`").cast("string")
        columns.append(typed(name, value).alias(name))
    return raw.select(*columns)


def select_api_fields(raw: DataFrame, fields: Sequence[str] = API_FIELDS) -> DataFrame:
    """The wanted columns, as far as they are there."""
    return raw.select(*[field for field in fields if field in raw.columns])


def add_is_landline(calls: DataFrame) -> DataFrame:
    """P2"""
    return calls.withColumn("is_landline", is_landline(F.col("caller")))


def drop_redundant(calls: DataFrame, columns: Sequence[str] = REDUNDANT) -> DataFrame:
    """P3"""
    return calls.drop(*columns)


def hash_column(calls: DataFrame, column: str = "caller", salt: str | None = None) -> DataFrame:
    """P4"""
    return calls.withColumn(column, pseudonym(F.col(column), salt))


def clean_calls(
    raw: DataFrame,
    areas: DataFrame,
    area_columns: Sequence[str] = AREA_COLUMNS,
    on_bad: str = "error",
    salt: str | None = None,
    observe: Observation | None = None,
) -> DataFrame:
    """P5: parse, flag landline, drop provider columns, locate, pseudonymise.

    Calls without a number are dropped; an observation counts them while the
    job runs (rows_in, rows_without_number). Duplicates stay, see
    remove_duplicate_calls. All steps are narrow, so cleaning is one stage.
    """
    return clean_parsed(parse_records(raw), areas, area_columns, on_bad, salt, observe)


def clean_parsed(
    parsed: DataFrame,
    areas: DataFrame,
    area_columns: Sequence[str] = AREA_COLUMNS,
    on_bad: str = "error",
    salt: str | None = None,
    observe: Observation | None = None,
) -> DataFrame:
    """P5 from the second step on, for records that are parsed already."""
    parsed = add_is_landline(parsed)
    if observe is not None:
        parsed = parsed.observe(
            observe,
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(F.col("caller").isNull()).alias("rows_without_number"),
        )
    numbered = drop_redundant(parsed).filter(F.col("is_landline").isNotNull())
    return hash_column(attach_area(numbered, areas, area_columns, on_bad), salt=salt)


def repair_umlauts(calls: DataFrame, column: str = "state") -> DataFrame:
    """Ue written for ü in names of states."""
    return calls.withColumn(column, F.regexp_replace(column, "ue", "ü"))


def adopt_legacy_column(
    calls: DataFrame, old: str = "landline", new: str = "is_landline"
) -> DataFrame:
    """Copy a legacy column to its new name, as the type it has there."""
    return calls.withColumn(new, typed(new, F.col(old).cast("string")))
