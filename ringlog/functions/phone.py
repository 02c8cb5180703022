"""Phone numbers and the labels that depend on where a call came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringlog.schema import MOBILE, UNKNOWN

# Mobile and freephone numbers begin so.
NOT_LANDLINE = ["00491", "491", "0049800", "49800"]


def is_landline(number: Column) -> Column:
    """Null stays null. Needs the number itself, so it goes before the hash."""
    return ~reduce(Column.__or__, [number.startswith(begin) for begin in NOT_LANDLINE])


def pseudonym(value: Column, salt: str | None = None) -> Column:
    """SHA-256 in lowercase hex.

    Without a salt all phone numbers can be tried out; pass one (the same for
    all runs, as callers are told apart by it) where that matters.
    """
    text = value.cast("string")
    return F.sha2(F.concat(F.lit(salt), text) if salt else text, 256)


def origin_label(state_code: Column, landline: Column) -> Column:
    """P14"""
    return (
        F.when(state_code.isNull() & landline, F.lit(UNKNOWN))
        .when(~landline, F.lit(MOBILE))
        .otherwise(state_code)
    )


def map_label(state: Column, landline: Column) -> Column:
    """A landline call of unknown state has no label."""
    return F.when(~landline, F.lit("mobil")).when(landline, state)
