"""Find the area a landline number belongs to.

Codes of four lengths are looked up by equality with the beginning of the number.
The areas are counted first and broadcast if they are few; else adaptive execution
chooses the joins, and cuts frequent beginnings into parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlog.operators.groups import broadcast_if_small, join_back

# Lengths of 0049 and the rest of an area code, longest first.
PREFIX_LENGTHS = (9, 8, 7, 6)
AREA_COLUMNS = ("area_name", "state", "plz")

ON_BAD = ("error", "null", "flag")


def area_lookup(areas: DataFrame, columns: Sequence[str] = AREA_COLUMNS) -> DataFrame:
    """One row per code: area, a struct of its attributes, and whether it has several.

    A code with rows that differ in any attribute has several; area is then the
    first of them, by name and then by the other attributes, where a known value
    comes before a missing one.
    """
    found = ["area_name", *[c for c in columns if c in areas.columns and c != "area_name"]]
    order = [x for c in found for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    rows = areas.select("area_code", *found).distinct()
    grouped = rows.groupBy("area_code").agg(
        F.min(F.struct(*order)).alias("area"), (F.count(F.lit(1)) > 1).alias("several")
    )
    area = F.struct(*[F.col("area")[c].alias(c) for c in found]).alias("area")
    return grouped.filter("area_code is not null").select("area_code", area, "several")


def attach_area(
    calls: DataFrame,
    areas: DataFrame,
    columns: Sequence[str] = AREA_COLUMNS,
    on_bad: str = "error",
) -> DataFrame:
    """Add area_code and the area's attributes to landline calls.

    Every landline number should match one area. If not: "error" fails the
    job at the first such number, "null" takes the longest match or none, and
    "flag" does the same and adds area_matches, to be split by
    split_area_matches. Calls from elsewhere pass with nulls; calls whose
    is_landline is null pass too, and are for clean_calls to drop.

    A match of a code with several areas counts as two. Each call goes through
    four lookups and stays one row, so there is no lookup of distinct numbers to
    put back on the calls (J4). Where the areas are broadcast, as an ordinary
    table of codes is, that is one stage without a shuffle.
    """
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {', '.join(ON_BAD)}")
    found = [c for c in columns if c in areas.columns]
    # An area without a name is no match.
    named = areas.filter(F.col("area_name").isNotNull())
    lookup = broadcast_if_small(area_lookup(named, columns))
    located = calls.drop("area_code", *columns)
    inputs = located.columns
    for length in PREFIX_LENGTHS:
        side = lookup.select(
            F.col("area_code").alias(f"code_{length}"),
            F.col("area").alias(f"area_{length}"),
            F.col("several").alias(f"several_{length}"),
        )
        prefix = F.when(F.col("is_landline"), F.substring("caller", 1, length))
        located = located.join(side, prefix == F.col(f"code_{length}"), "left")

    def longest(name: str) -> Column:
        return F.coalesce(*[F.col(f"{name}_{length}") for length in PREFIX_LENGTHS])

    # Different names found, where no match at some length counts as a name of
    # its own; a code that has several names itself is worth one more.
    names = [F.col(f"area_{length}.area_name") for length in PREFIX_LENGTHS]
    missed = reduce(Column.__or__, [name.isNull() for name in names])
    several = [F.coalesce(F.col(f"several_{n}").cast("int"), F.lit(0)) for n in PREFIX_LENGTHS]
    count = F.size(F.array_distinct(F.array(*names))) - missed.cast("int")
    matches = F.when(F.col("is_landline"), reduce(Column.__add__, several, count)).cast("bigint")
    if on_bad == "error":
        complaint = F.concat(
            F.lit("landline number does not match exactly one area: "),
            F.substring("caller", 1, PREFIX_LENGTHS[0]),
            F.lit("..."),
        )
        bad = matches != 1
        located = located.filter(
            F.when(bad, F.raise_error(complaint).cast("boolean")).otherwise(F.lit(True))
        )
    return located.select(
        *inputs,
        longest("code").alias("area_code"),
        *[longest("area")[c].alias(c) for c in found],
        *([matches.alias("area_matches")] if on_bad == "flag" else []),
    )


def split_area_matches(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls located as they should be, and those to set aside."""
    bad = F.coalesce(F.col("area_matches") != 1, F.lit(False))
    return flagged.filter(~bad).drop("area_matches"), flagged.filter(bad)


def match_counts(calls: DataFrame, areas: DataFrame) -> DataFrame:
    """How many areas each landline number matches."""
    numbers = calls.filter("is_landline").select("caller", "is_landline").distinct()
    return attach_area(numbers, areas, on_bad="flag").select(
        "caller", F.col("area_matches").alias("matches")
    )


def match_distribution(calls: DataFrame, areas: DataFrame) -> DataFrame:
    """How many numbers have so many matches."""
    return match_counts(calls, areas).groupBy("matches").agg(F.count("*").alias("numbers"))


def bad_matches(calls: DataFrame, areas: DataFrame) -> DataFrame:
    """Every landline number at fault, and how many areas it matches."""
    return match_counts(calls, areas).filter(F.col("matches") != 1)


def assert_area_matches(calls: DataFrame, areas: DataFrame) -> None:
    """Stop before a long job; bad_matches has all numbers at fault."""
    none, several = (
        bad_matches(calls, areas)
        .agg(F.count_if(F.col("matches") == 0), F.count_if(F.col("matches") > 1))
        .first()
    )
    if none or several:
        raise ValueError(f"without an area: {none} landline numbers; with several: {several}")


def prefix_candidates(calls: DataFrame) -> DataFrame:
    """Every landline number with each of the codes it may begin with."""
    numbers = calls.filter("is_landline").select("caller").distinct()
    lengths = F.array(*[F.lit(length) for length in sorted(PREFIX_LENGTHS)])
    return numbers.select("caller", F.explode(lengths).alias("prefix_length")).withColumn(
        "area_code", F.substring(F.col("caller"), F.lit(1), F.col("prefix_length"))
    )


def attach_area_anywhere(
    calls: DataFrame, areas: DataFrame, landline_only: bool = False
) -> DataFrame:
    """Match a code found anywhere in the number, as before J1.

    A call is repeated for every code found in its number, and kept with nulls
    when there is none. All pieces of a number that are as long as some code are
    looked up by equality, as a join on "contains" would compare each call with
    each code. The lengths are asked of the area table first: a code has no more
    characters than a number.
    """
    columns = [c for c in AREA_COLUMNS if c in areas.columns]
    calls = calls.drop("area_code", *AREA_COLUMNS)
    numbers = (calls.filter("is_landline") if landline_only else calls).select("caller").distinct()
    lookup = broadcast_if_small(area_lookup(areas).select("area_code", "area.*"))
    sizes = areas.select(F.length("area_code").alias("n")).filter("n > 0").distinct()
    lengths = sorted(row.n for row in sizes.collect()) or [1]
    starts = F.sequence(F.lit(1), F.greatest(F.length("caller"), F.lit(1)))
    pieces = F.flatten(
        F.transform(
            starts,
            lambda start: F.array(
                *[F.substring(F.col("caller"), start, F.lit(n)) for n in lengths]
            ),
        )
    )
    hits = (
        numbers.filter(F.col("caller").isNotNull())
        .select("caller", F.explode(F.array_distinct(pieces)).alias("area_code"))
        .join(lookup, "area_code")
        .select("caller", "area_code", *columns)
    )
    return join_back(calls, hits, ["caller"])


def area_code_lengths(table: DataFrame) -> DataFrame:
    """Length of the codes in a table, with one 0 in place of 0049."""
    return table.groupBy((F.length("area_code") - 3).alias("code_length")).agg(
        F.count("*").alias("n")
    )
