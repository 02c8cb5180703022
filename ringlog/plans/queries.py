"""The registered queries: each operator on whole tables, by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringlog.functions import clock_text, display_count, display_date, hour_of
from ringlog.operators import (
    attempts,
    clean,
    daily,
    geo,
    origin,
    patterns,
    period,
    quality,
    series,
    spread,
)
from ringlog.operators import states as state_reports
from ringlog.operators.first_call import mark_first_calls
from ringlog.operators.refresh import last_day, refresh_calls
from ringlog.operators.view import Place, page, page_after
from ringlog.plans import reports
from ringlog.schema import AREA_FIELDS, FILE_COLUMNS, LEGACY_FIELDS, state_table
from ringlog.session import work_path
from ringlog.sources import landing, samples
from ringlog.sources.callers import callers_path, write_callers
from ringlog.sources.export import export_name, export_report
from ringlog.sources.files import read_annual, read_areas, read_legacy, read_states
from ringlog.sources.synthetic import synthetic_calls
from ringlog.plans.tables import build_table, refresh_table, split_legacy
from ringlog.sources.table import (
    begin_replacement,
    finish_replacement,
    new_stage,
    read_calls,
    write_calls,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table as reports read it."""
    return mark_first_calls(samples.calls(spark, sf))


# Period reports and series


@query
def period_week(spark, sf):
    return period.period_report(flagged(spark, sf), "week")


@query
def period_month(spark, sf):
    return period.period_report(flagged(spark, sf), "month")


@query
def period_year(spark, sf):
    return period.period_report(flagged(spark, sf), "year")


@query
def period_day(spark, sf):
    return period.newest_first(period.period_report(flagged(spark, sf), "day"))


@query
def shown_week(spark, sf):
    return reports.shown(flagged(spark, sf), "week")


@query
def shown_origin(spark, sf):
    return reports.shown(flagged(spark, sf), "origin")


@query
def data_bounds(spark, sf):
    return period.data_bounds(samples.calls(spark, sf))


@query
def clamped_period(spark, sf):
    return period.clamped_period(samples.calls(spark, sf), "1990-01-01", None)


@query
def weekly_series(spark, sf):
    return series.weekly_series(samples.calls(spark, sf))


@query
def weekly_series_state(spark, sf):
    return series.weekly_series(samples.calls(spark, sf), only_success=False, state="Berlin")


@query
def weekly_series_first(spark, sf):
    return series.weekly_series(flagged(spark, sf), only_success=False, only_first=True)


# Cleaning and location


@query
def first_call(spark, sf):
    return flagged(spark, sf).select("id", "caller", "first_call")


def _rerouted_with_ids(spark, sf, id_):
    """Rerouted pairs, whose calls share caller and moment, with other ids."""
    return samples.rerouted_calls(spark, sf).withColumn("id", id_)


@query
def first_call_without_ids(spark, sf):
    none = F.lit(None).cast("string")
    marked = mark_first_calls(_rerouted_with_ids(spark, sf, none))
    return marked.select("caller", "call_date", "time_s", "module", "first_call")


@query
def first_call_mixed_ids(spark, sf):
    key = F.regexp_replace("id", "^r", "")
    some = F.when(key.cast("bigint") % 3 > 0, key)
    marked = mark_first_calls(_rerouted_with_ids(spark, sf, some))
    return marked.select("id", "caller", "call_date", "time_s", "module", "first_call")


@query
def period_week_range(spark, sf):
    return period.period_report(flagged(spark, sf), "week", "1996-03-05", "1998-10-20")


@query
def origin_range(spark, sf):
    calls, states = flagged(spark, sf), state_table(spark)
    return origin.origin_report(calls, states, "1996-03-05", "1998-10-20")


@query
def record_count_range(spark, sf):
    return quality.record_count(samples.calls(spark, sf), "1996-03-05", "1998-10-20")


@query
def period_year_with_gaps(spark, sf):
    """Withheld numbers and calls of unknown outcome."""
    key = F.col("id").cast("bigint")
    calls = samples.calls(spark, sf).withColumns(
        {
            "caller": F.when(key % 11 > 0, F.col("caller")),
            "success": F.when(key % 13 > 0, F.col("success")),
        }
    )
    return period.period_report(mark_first_calls(calls), "year")


@query
def landline_kinds(spark, sf):
    """Freephone numbers, and numbers that begin with 49."""
    key, raw = F.col("id").cast("bigint"), samples.raw_records(spark, sf)
    kinds = F.when(key % 5 == 0, F.concat(F.lit("0049800"), "id")).when(
        key % 5 == 1, F.substr("caller", F.lit(3))
    )
    found = raw.withColumn("caller", F.coalesce(kinds, "caller"))
    return clean.add_is_landline(found).select("id", "caller", "is_landline")


@query
def dedup_strict(spark, sf):
    calls = mark_first_calls(samples.rerouted_calls(spark, sf))
    return quality.remove_duplicate_calls(calls, strict=True)


@query
def parsed_records(spark, sf):
    return clean.parse_records(samples.raw_records(spark, sf))


@query
def landline_flag(spark, sf):
    return clean.add_is_landline(samples.raw_records(spark, sf)).select(
        "id", "caller", "is_landline"
    )


@query
def hash_caller(spark, sf):
    return clean.hash_column(samples.raw_records(spark, sf)).select("id", "caller")


@query
def clean_calls(spark, sf):
    return clean.clean_calls(samples.raw_records(spark, sf), samples.areas(spark, sf))


def _numbered(spark, sf):
    raw = clean.add_is_landline(samples.raw_records(spark, sf))
    return raw.select("id", "caller", "is_landline")


def _numbered_oddly(spark, sf):
    """One in 17 landline numbers begins with a code that no area has."""
    raw, caller = samples.raw_records(spark, sf), F.col("caller")
    odd = (F.col("id").cast("bigint") % 17 == 0) & ~caller.startswith("00491")
    moved = F.when(odd, F.concat(F.lit("0049777"), F.substr(caller, F.lit(8)))).otherwise(caller)
    numbered = clean.add_is_landline(raw.withColumn("caller", moved))
    return numbered.select("id", "caller", "is_landline")


@query
def area_prefix_join(spark, sf):
    return geo.attach_area(_numbered(spark, sf), samples.areas(spark, sf))


@query
def area_quarantine(spark, sf):
    found = geo.attach_area(_numbered_oddly(spark, sf), samples.areas(spark, sf), on_bad="flag")
    return geo.split_area_matches(found)[1]


@query
def area_contains_join(spark, sf):
    return geo.attach_area_anywhere(_numbered(spark, sf), samples.areas(spark, sf))


@query
def prefix_match_check(spark, sf):
    return geo.match_counts(_numbered_oddly(spark, sf), samples.areas(spark, sf))


@query
def prefix_match_distribution(spark, sf):
    return geo.match_distribution(_numbered_oddly(spark, sf), samples.areas(spark, sf))


@query
def prefix_candidates(spark, sf):
    return geo.prefix_candidates(_numbered(spark, sf))


@query
def area_code_lengths(spark, sf):
    found = geo.attach_area(_numbered(spark, sf), samples.areas(spark, sf))
    return geo.area_code_lengths(found.filter("area_code is not null"))


@query
def repaired_umlauts(spark, sf):
    names = samples.areas(spark, sf).select("area_code", F.concat("area_name", F.lit("ue ")).alias("state"))
    calls = samples.calls(spark, sf).drop("state").join(names, "area_code", "left")
    return clean.repair_umlauts(calls).select("id", "state")


@query
def legacy_column(spark, sf):
    text = F.when(F.col("is_landline"), "TRUE").when(F.col("id").cast("bigint") % 3 > 0, "FALSE")
    old = samples.calls(spark, sf).select("id", F.coalesce(text, F.lit("NA")).alias("landline"))
    return clean.adopt_legacy_column(old).select("id", "landline", "is_landline")


# Origin and map


@query
def origin_long(spark, sf):
    return origin.origin_report(flagged(spark, sf), state_table(spark))


@query
def origin_pivot(spark, sf):
    return origin.pivot_origins(origin.origin_report(flagged(spark, sf), state_table(spark)))


@query
def origin_totals(spark, sf):
    return origin.origin_totals(flagged(spark, sf), state_table(spark))


@query
def week_bounds(spark, sf):
    return origin.with_week_bounds(samples.calls(spark, sf)).select(
        "id", "iso_year", "iso_week", "week_first", "week_last"
    )


@query
def state_map_calls(spark, sf):
    return state_reports.state_map(samples.calls(spark, sf), state_table(spark), "calls")


@query
def state_map_callers(spark, sf):
    return state_reports.state_map(samples.calls(spark, sf), state_table(spark), "callers")


@query
def state_map_first(spark, sf):
    return state_reports.state_map(
        flagged(spark, sf), state_table(spark), "first_callers", only_success=True
    )


@query
def mobile_landline_totals(spark, sf):
    return state_reports.mobile_and_landline(samples.calls(spark, sf), "callers")


@query
def state_attributes(spark, sf):
    attributes = samples.calls(spark, sf).select(
        F.col("id").alias("OBJECTID"), F.col("state").alias("NAME_1")
    )
    return state_reports.state_attributes(attributes, state_table(spark))


# Weekdays and hours


@query
def hour_success(spark, sf):
    return patterns.successful_by_hour(samples.calls(spark, sf))


@query
def hour_success_strict(spark, sf):
    return patterns.successful_by_hour(samples.event_calls(spark, sf), strict=True)


@query
def hour_of_call(spark, sf):
    return samples.event_calls(spark, sf).select("id", hour_of(F.col("time_s")).alias("hour"))


@query
def weekday_calls(spark, sf):
    return patterns.calls_by_weekday(samples.calls(spark, sf))


@query
def weekday_success(spark, sf):
    return patterns.calls_by_weekday_success(samples.calls(spark, sf))


@query
def weekday_fail_share(spark, sf):
    return patterns.fail_share_by_weekday(samples.calls(spark, sf))


@query
def heat_all(spark, sf):
    return patterns.heat_table(samples.calls(spark, sf))


@query
def heat_daytime(spark, sf):
    return patterns.heat_table(samples.calls(spark, sf), *patterns.DAYTIME)


@query
def heat_fail(spark, sf):
    return patterns.heat_table(samples.calls(spark, sf), *patterns.DAYTIME, only_failed=True)


@query
def heat_fail_share(spark, sf):
    return patterns.fail_share_table(samples.calls(spark, sf))


# Attempts


@query
def attempts_per_day(spark, sf):
    return attempts.with_attempts(samples.event_calls(spark, sf)).select(
        "id", "caller", "call_date", "attempts", "successes"
    )


@query
def caller_days(spark, sf):
    return attempts.caller_days(samples.event_calls(spark, sf))


@query
def attempt_hist(spark, sf):
    return attempts.attempt_histogram(samples.event_calls(spark, sf))


@query
def attempt_hist_strict(spark, sf):
    return attempts.attempt_histogram(samples.event_calls(spark, sf), strict=True)


@query
def attempt_hist_fail(spark, sf):
    return attempts.attempt_histogram(
        samples.event_calls(spark, sf), strict=True, only_failed=True
    )


@query
def attempt_quantiles(spark, sf):
    return attempts.attempt_quantiles(samples.event_calls(spark, sf))


# Duplicates, coverage, spread


@query
def dup_multiplicity(spark, sf):
    return quality.with_multiplicity(samples.rerouted_calls(spark, sf)).select("id", "n", "is_dup")


@query
def dup_by_year(spark, sf):
    return quality.duplicates_by_year(samples.rerouted_calls(spark, sf))


@query
def dup_pairs(spark, sf):
    return quality.duplicate_pairs(samples.rerouted_calls(spark, sf))


@query
def dup_groups(spark, sf):
    return quality.worst_first(quality.duplicate_groups(samples.rerouted_calls(spark, sf)))


@query
def dup_compare(spark, sf):
    return quality.compare_duplicates(
        samples.rerouted_calls(spark, sf), samples.calls(spark, sf)
    )


@query
def dup_crosstab_success(spark, sf):
    return quality.duplicate_crosstab(
        samples.rerouted_calls(spark, sf), F.col("success"), "success"
    )


@query
def dup_crosstab_module(spark, sf):
    return quality.duplicate_crosstab(samples.rerouted_calls(spark, sf), F.col("module"), "module")


@query
def dup_crosstab_zero(spark, sf):
    return quality.duplicate_crosstab(
        samples.rerouted_calls(spark, sf), F.col("duration_in") == 0, "no_duration"
    )


@query
def module_success(spark, sf):
    return quality.crosstab(
        samples.rerouted_calls(spark, sf), "module", "success", [False, True], "success_"
    )


@query
def dedup_calls(spark, sf):
    return quality.remove_duplicate_calls(samples.rerouted_calls(spark, sf))


@query
def distinct_check(spark, sf):
    return quality.distinct_check(samples.rerouted_calls(spark, sf).drop("id", "module"))


@query
def missing_days(spark, sf):
    return quality.missing_days(samples.calls(spark, sf))


@query
def calls_per_day(spark, sf):
    return quality.calls_per_day(samples.calls(spark, sf)).orderBy("n", "call_date")


@query
def daily_box_stats(spark, sf):
    return quality.daily_box_stats(samples.calls(spark, sf))


@query
def daily_outliers(spark, sf):
    return quality.daily_outliers(samples.calls(spark, sf))


@query
def six_number_summary(spark, sf):
    return quality.six_numbers(quality.multiplicities(samples.rerouted_calls(spark, sf)), "n")


# Sources, sinks, refresh


@query
def api_records(spark, sf):
    raw = samples.raw_records(spark, sf)
    body = F.to_json(F.struct(F.struct(F.array(F.struct(*raw.columns)).alias("data")).alias("response")))
    return landing.parse_responses(raw.select(body.alias("body")), "body")


@query
def api_projection(spark, sf):
    raw = samples.raw_records(spark, sf).withColumn("trace", F.lit("x"))
    return clean.select_api_fields(raw)


@query
def redundant_columns(spark, sf):
    return clean.drop_redundant(samples.raw_records(spark, sf))


@query
def record_count(spark, sf):
    return quality.record_count(samples.calls(spark, sf))


@query
def chunk_plan(spark, sf):
    return landing.chunk_plan(samples.calls(spark, sf), limit=1000, target=700)


@query
def union_by_name(spark, sf):
    wide, narrow = samples.calls(spark, sf), samples.event_calls(spark, sf)
    return wide.unionByName(narrow, allowMissingColumns=True).select(
        "id", "call_date", "time_s", "caller", "success", "state", "is_landline"
    )


@query
def refreshed_table(spark, sf):
    """A table of the calls up to a day, by year, brought up to date from API records."""
    turn = F.lit("1998-01-01").cast("date")
    path = work_path(spark, "table")
    old = samples.calls(spark, sf).filter(F.col("call_date") <= turn)
    hashed = clean.hash_column(old)
    write_calls(mark_first_calls(hashed), path, by_day=False)
    records = samples.raw_records(spark, sf).filter(F.col("date") >= "1998-01-01")
    refresh_table(spark, path, records, samples.areas(spark, sf), None)
    kept = ["id", "call_date", "time_s", "caller", "state", "first_call"]
    return read_calls(spark, path).select(*kept)


@query
def table_by_day(spark, sf):
    path = work_path(spark, "days")
    write_calls(mark_first_calls(samples.event_calls(spark, sf)), path)
    return read_calls(spark, path)


@query
def annual_roundtrip(spark, sf):
    path = work_path(spark, "annual")
    write_calls(flagged(spark, sf), path, format="csv")
    return read_annual(spark, path)


@query
def refresh_replace_day(spark, sf):
    every = samples.calls(spark, sf)
    turn = F.lit("2000-01-01").cast("date")
    noon = (F.col("call_date") == turn) & (F.col("time_s") < 12 * 3600)
    old = every.filter((F.col("call_date") < turn) | noon)
    path = work_path(spark, "stored")
    mark_first_calls(old).write.parquet(path)
    stored = spark.read.parquet(path)
    start = last_day(stored)
    return refresh_calls(stored, every.filter(F.col("call_date") >= F.lit(start)), start)


@query
def export_names(spark, sf):
    calls = flagged(spark, sf)
    return export_name(period.period_report(calls, "week"), "week")


@query
def display_formats(spark, sf):
    return quality.calls_per_day(samples.calls(spark, sf)).select(
        "call_date",
        display_date(F.col("call_date")).alias("day_label"),
        display_count(1000 * F.col("n")).alias("count_label"),
    )


@query
def table_view_page(spark, sf):
    report = period.period_report(flagged(spark, sf), "day")
    return page(report, 2, [F.desc("calls"), F.desc("call_date")], ["calls >= 1"])


@query
def synth_calls(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return synthetic_calls(
        orders.select(F.col("o_orderkey").alias("n")), samples.areas(spark, sf)
    )


# Files and tables in the forms that are exchanged


@query
def annual_line_breaks(spark, sf):
    """Cells that hold a line break and quotes."""
    path = work_path(spark, "annual")
    broken = F.concat(F.lit('"'), "area_name", F.lit('"\n'), "plz")
    write_calls(flagged(spark, sf).withColumn("area_name", broken), path, format="csv")
    return read_annual(spark, path)


def _legacy_file(spark, sf):
    path = work_path(spark, "legacy")
    rows = flagged(spark, sf).withColumn("time_s", clock_text(F.col("time_s")))
    names = {"landline": "is_landline"} | FILE_COLUMNS
    columns = [F.col(names[field]).alias(f"column {k}") for k, field in enumerate(LEGACY_FIELDS)]
    rows.select(*columns).write.options(header="true", escape='"').csv(path)
    return path


@query
def legacy_file(spark, sf):
    """S2"""
    return read_legacy(spark, _legacy_file(spark, sf))


@query
def legacy_split(spark, sf):
    """P19"""
    found = split_legacy(spark, _legacy_file(spark, sf), work_path(spark, "days"))
    return found.select("call_date", "time_s", "caller", "area_code", "first_call", "year", "day")


@query
def area_file(spark, sf):
    """S3"""
    path = work_path(spark, "areas")
    names = {column: heading for heading, column in AREA_FIELDS.items()}
    areas = samples.areas(spark, sf).select(*names).withColumnsRenamed(names)
    areas.write.options(header="true", escape='"').csv(path)
    return read_areas(spark, path)


@query
def state_file(spark, sf):
    """The states that the areas are in, with a place made from their codes."""
    path = work_path(spark, "states")
    code = F.col("area_code").cast("bigint") % 90
    found = samples.areas(spark, sf).join(state_table(spark), "state").groupBy("state", "state_code")
    found.agg((F.min(code) / 2).alias("lat"), (-F.max(code) / 4).alias("lon")).select(
        F.col("state").alias("Bundesland"),
        F.col("state_code").alias("bl_short"),
        F.col("lat").alias("lat_correct"),
        F.col("lon").alias("lon_correct"),
    ).write.option("header", "true").csv(path)
    return read_states(spark, path)


@query
def area_some_columns(spark, sf):
    """J1a"""
    return geo.attach_area(_numbered(spark, sf), samples.areas(spark, sf), ["state"])


@query
def area_several(spark, sf):
    """One code in five has a second area, and codes are parts of longer ones."""
    areas = samples.areas(spark, sf)
    again = areas.filter(F.col("n_nationkey") % 5 == 0)
    nested = areas.filter(F.col("n_nationkey") % 4 == 2)
    areas = (
        areas.union(again.withColumn("area_name", F.concat(F.lit("Neu "), "area_name")))
        .union(nested.withColumn("area_code", F.substring("area_code", 1, 6)))
        .drop("n_nationkey")
    )
    found = geo.attach_area(_numbered_oddly(spark, sf), areas, on_bad="flag")
    return found.select("id", F.substring("caller", 1, 9).alias("dialled"), "area_matches")


@query
def attempts_beyond_the_cap(spark, sf):
    """Few callers, so that most days have more attempts than are shown."""
    calls = samples.event_calls(spark, sf)
    few = calls.withColumn("caller", F.right(F.col("caller"), F.lit(1)))
    return attempts.attempt_histogram(few)


@query
def some_years_written(spark, sf):
    """Of a table two years are written again, without the calls of mobiles."""
    path = work_path(spark, "years")
    calls = flagged(spark, sf)
    write_calls(calls, path)
    write_calls(calls.filter("is_landline"), path, years=[1994, 1996])
    return read_calls(spark, path).select("id", "caller", "year", "day")


@query
def rows_out_of_order(spark, sf):
    """O2: rows of the table's files, and those that come after a later one in their file."""
    path = work_path(spark, "sorted")
    write_calls(flagged(spark, sf), path, by_day=False)
    rows = spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.struct("call_date", "time_s", "caller").alias("key"),
    )
    before = F.lag("key").over(Window.partitionBy("file").orderBy("row"))
    return rows.withColumn("before", before).agg(
        F.count("*").alias("n"), F.count_if(F.col("before") > F.col("key")).alias("late")
    )


@query
def export_content(spark, sf):
    """What a reader of an exported report finds, all text."""
    report = period.period_report(flagged(spark, sf), "week").withColumn("note", F.lit('a "b", c'))
    path = export_report(report, work_path(spark, "export"), "week")
    return spark.read.options(header="true", escape='"').csv(path)


# Replacements, the index of callers, measures by day, pages


def _half_replaced(spark, sf):
    """A table whose last days are decided to be replaced and are not yet."""
    path = work_path(spark, "table")
    turn = dt.date(1997, 1, 1)
    calls = flagged(spark, sf)
    early = calls.filter(F.col("call_date") < F.lit(turn))
    old = calls.filter(F.col("call_date") >= F.lit(turn)).filter("is_landline")
    build_table(spark, early.union(old), path, by_day=False)
    folder = new_stage(path)
    write_calls(calls.filter(F.col("call_date") >= F.lit(turn)), f"{folder}/table", by_day=False)
    write_callers(read_calls(spark, f"{folder}/table"), f"{folder}/callers")
    begin_replacement(spark, folder, path, turn)
    return path


@query
def replacement_pending(spark, sf):
    """R2: a reader sees the table as it will be."""
    return read_calls(spark, _half_replaced(spark, sf)).drop("year")


@query
def replacement_finished(spark, sf):
    """R2: whoever comes next puts what is pending in its place."""
    path = _half_replaced(spark, sf)
    finish_replacement(spark, path)
    return read_calls(spark, path).drop("year")


@query
def caller_index(spark, sf):
    """Each caller's first day, kept by a refresh."""
    path = work_path(spark, "table")
    calls = samples.event_calls(spark, sf).withColumn("is_landline", F.lit(False))
    middle = calls.agg(F.percentile("time_s", 0.5)).first()[0]
    build_table(spark, clean.hash_column(calls.filter(F.col("time_s") < middle)), path)
    rest = calls.filter(F.col("time_s") >= middle)
    records = rest.select(
        "id",
        F.date_format("call_date", "yyyy-MM-dd").alias("date"),
        clock_text(F.col("time_s")).alias("time"),
        F.concat(F.lit("004915"), "caller").alias("caller"),
        F.col("duration_in").cast("string").alias("duration_inbound"),
        F.col("duration_out").cast("string").alias("duration_outbound"),
        F.col("success").cast("string").alias("success"),
    )
    refresh_table(spark, path, records, samples.areas(spark, sf), None)
    return spark.read.parquet(callers_path(path)).select("caller", "first_day")


@query
def months_of_days(spark, sf):
    """A2, A5: all measures from days, and whether the estimate of callers is within 5 %."""
    calls = flagged(spark, sf)
    path = work_path(spark, "measures")
    daily.day_measures(calls).write.parquet(path)
    found = daily.report_of_days(spark.read.parquet(path), "month").drop("calls_per_caller")
    exact = period.period_report(calls, "month").select("year", "month", F.col("callers").alias("n"))
    near = F.abs(F.col("callers") - F.col("n")) <= 0.05 * F.col("n") + 1
    return found.join(exact, ["year", "month"]).withColumn("callers", near).drop("n")


@query
def weeks_of_days(spark, sf):
    """A1 of days, for a period; callers left out."""
    days = daily.day_measures(flagged(spark, sf))
    found = daily.report_of_days(days, "week", "1994-02-03", "1996-11-12")
    return found.drop("callers", "calls_per_caller")


@query
def attempt_quantiles_of_days(spark, sf):
    """Whether quantiles from days have their ranks among the caller-days, by year."""
    calls = samples.event_calls(spark, sf)
    path = work_path(spark, "spread")
    spread.day_spread(calls).write.parquet(path)
    found = spread.attempt_quantiles(spark.read.parquet(path), "year").withColumnRenamed("year", "y")
    counts = attempts.caller_days(calls).groupBy(F.year("call_date").alias("year"), "attempts").agg(
        F.count("*").alias("frequency")
    )
    ranked = counts.join(found, F.col("year") == F.col("y"))
    near = {}
    for name, rank in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9)):
        below = F.sum(F.when(F.col("attempts") < F.col(name), F.col("frequency")).otherwise(0))
        upto = F.sum(F.when(F.col("attempts") <= F.col(name), F.col("frequency")).otherwise(0))
        bound, whole = 0.02, F.sum("frequency")
        near[name] = (below / whole <= rank + bound) & (upto / whole >= rank - bound)
    return ranked.groupBy("year").agg(*[test.alias(name) for name, test in near.items()])


@query
def talk_time_of_days(spark, sf):
    """Six numbers of the talk time by month from days; whether quartiles are in order."""
    path = work_path(spark, "spread")
    spread.day_spread(samples.calls(spark, sf)).write.parquet(path)
    found = spread.six_numbers(spark.read.parquet(path), "month")
    ordered = F.array("minimum", "q1", "median", "q3", "maximum")
    return found.withColumn("ordered", F.array_sort(ordered) == ordered).drop("q1", "median", "q3")


@query
def box_stats_of_days(spark, sf):
    """A29 from stored days."""
    path = work_path(spark, "spread")
    spread.day_spread(samples.calls(spark, sf)).write.parquet(path)
    return spread.box_stats(spark.read.parquet(path))


@query
def responses_by_index(spark, sf):
    """The records of some days, from the files that can hold them only."""
    raw = samples.raw_records(spark, sf)
    body = F.to_json(F.struct(F.struct(F.array(F.struct(*raw.columns)).alias("data")).alias("response")))
    path, index = work_path(spark, "responses"), work_path(spark, "responses-index")
    raw.repartitionByRange(8, "date").select(body.alias("value")).write.text(path)
    landing.index_responses(spark, path, index)
    bounds = ("1995-02-03", "1996-01-20")
    return landing.read_responses(spark, path, *bounds, index=index)


@query
def page_after_row(spark, sf):
    """The page after the last row of the page before."""
    report = period.period_report(flagged(spark, sf), "day").select("call_date", "calls", "callers")
    path = work_path(spark, "report")
    report.write.parquet(path)
    report = spark.read.parquet(path)
    order = {"calls": True, "call_date": True}
    last = page_after(report, order).tail(1)
    return page_after(report, order, Place(last[0], 1) if last else None)
