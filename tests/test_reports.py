"""Reports on rows made by hand, and identities between reports."""

import datetime as dt

import makers
import pytest
from pyspark.sql import functions as F

from ringlog.operators import attempts, origin, patterns, period, quality, series
from ringlog.operators import states as state_reports
from ringlog.operators.first_call import mark_first_calls
from ringlog.operators.view import page
from ringlog.plans import reports
from ringlog.schema import state_table
from ringlog.sources import samples


@pytest.fixture(scope="module")
def fact(spark, sf_dir):
    return mark_first_calls(samples.calls(spark, sf_dir)).cache()


def test_withheld_numbers(spark):
    calls = makers.calls(spark, [{"caller": None}, {"caller": None}, {"caller": "1"}])
    row = period.period_report(calls, "week").first()
    assert (row.calls, row.callers, row.calls_per_caller) == (1, 2, 0.5)
    estimated = period.period_report(calls, "week", approx=True).first()
    assert estimated.callers == 2


def test_iso_year(spark):
    calls = makers.calls(spark, [{"call_date": "2021-01-03"}, {"call_date": "2024-12-30"}])
    weeks = period.period_report(calls, "week").collect()
    assert sorted((row.iso_year, row.iso_week) for row in weeks) == [(2020, 53), (2025, 1)]


def test_nothing_successful(spark):
    row = period.period_report(makers.calls(spark, [{"success": False}]), "year").first()
    assert (row.calls_ok, row.mean_minutes, row.max_minutes) == (0, None, None)


def test_one_minute(spark):
    calls = makers.calls(
        spark,
        [
            {"duration_out": 59},
            {"duration_out": 60},
            {"duration_out": 5, "success": False},
            {"duration_out": 5, "success": None},
        ],
    )
    row = period.period_report(calls, "month").first()
    assert (row.calls, row.calls_ok, row.calls_lt_1min, row.max_minutes) == (4, 2, 1, 1.0)


def test_period_arguments(spark):
    calls = makers.calls(spark, [{"call_date": "2024-03-04"}, {"call_date": "2024-03-05"}])
    with pytest.raises(ValueError):
        period.period_report(calls, "quarter")
    assert period.period_report(calls, "day", "2024-03-05", "2024-03-05").count() == 1
    days = period.newest_first(period.period_report(calls, "day"))
    assert days.columns[:2] == ["call_date", "weekday"]
    assert [row.weekday for row in days.collect()] == ["Tue", "Mon"]
    with pytest.raises(ValueError):
        period.newest_first(calls.select("id"))


def test_headings(spark):
    calls = makers.calls(spark, [{}])
    shown = period.with_headings(period.period_report(calls, "week")).columns
    assert shown[:5] == ["Jahr", "Kalenderwoche", "Start", "Ende", "Anrufe"]
    assert shown[-1] == "Erstanrufer*innen" and "Längstes Telefonat (min)" in shown


def test_clamped_period(spark):
    calls = makers.calls(spark, [{"call_date": "2024-03-04"}, {"call_date": "2024-03-09"}])
    first, last = dt.date(2024, 3, 4), dt.date(2024, 3, 9)
    assert tuple(period.clamped_period(calls).first()) == (first, last)
    assert tuple(period.clamped_period(calls, "2024-03-06", "2030-01-01").first()) == (
        dt.date(2024, 3, 6),
        last,
    )


def test_weeks(spark):
    tuesday_to_sunday = [{"call_date": f"2024-03-{d:02}"} for d in range(5, 11)]
    ends_only = [{"call_date": "2024-03-11"}, {"call_date": "2024-03-17"}]
    weeks = series.weekly_series(makers.calls(spark, tuesday_to_sunday + ends_only)).collect()
    assert [(row.iso_week, row.n_calls) for row in weeks] == [(11, 2)]


def test_series_filters(spark):
    monday, sunday = {"call_date": "2024-03-11"}, {"call_date": "2024-03-17"}
    calls = makers.calls(
        spark,
        [
            monday | {"first_call": True, "state": "Berlin"},
            sunday | {"first_call": True, "state": "Berlin"},
            sunday | {"success": False},
        ],
    )
    assert series.weekly_series(calls, only_success=False).first().n_calls == 3
    assert series.weekly_series(calls).first().n_calls == 2
    assert series.weekly_series(calls, only_first=True, state="Berlin").first().n_calls == 2
    assert series.weekly_series(calls, state="Bayern").isEmpty()
    assert series.weekly_series(calls, stop="2024-03-16").isEmpty()


def test_origin_labels(spark):
    calls = makers.calls(
        spark,
        [
            {"is_landline": True, "state": None},
            {"is_landline": False, "state": "Berlin"},
            {"is_landline": True, "state": "Berlin"},
            {"is_landline": True, "state": "Atlantis"},
            {"is_landline": None, "state": None},
        ],
    )
    labelled = origin.add_origin(calls, state_table(spark))
    assert makers.by_id(labelled, "origin") == {
        "1": "Unbk.",
        "2": "Mobil",
        "3": "BE",
        "4": "Unbk.",
        "5": None,
    }


def test_origin_pivot(spark):
    calls = makers.calls(
        spark,
        [
            {"caller": "1", "state": "Thüringen", "call_date": "2024-03-06"},
            {"caller": "1", "state": "Bayern", "call_date": "2024-03-05", "first_call": True},
            {"caller": "2", "is_landline": False, "call_date": "2024-03-08"},
            {"caller": "3", "is_landline": None, "call_date": "2024-03-08"},
        ],
    )
    report = origin.origin_report(calls, state_table(spark))
    pivoted = origin.pivot_origins(report)
    row = pivoted.first()
    assert (row.iso_year, row.iso_week) == ("2024", 10)
    assert (str(row.first_date), str(row.last_date)) == ("2024-03-05", "2024-03-08")
    assert (row.all_calls, row.all_callers, row.all_first_callers) == (4, 4, 1)
    assert (row.by_first_callers, row.th_callers, row.mobil_calls, row.na_calls) == (1, 1, 1, 1)
    assert row.be_calls == 0
    present = origin.pivot_origins(report, only_present=True)
    assert present.columns == (
        ["iso_year", "iso_week", "first_date", "last_date"]
        + ["all_calls", "all_callers", "all_first_callers"]
        + ["mobil_calls", "mobil_callers", "mobil_first_callers"]
        + ["by_calls", "by_callers", "by_first_callers"]
        + ["na_calls", "na_callers", "na_first_callers"]
        + ["th_calls", "th_callers", "th_first_callers"]
    )
    shown = origin.with_origin_headings(present).columns
    assert shown[:5] == ["Jahr", "Kalenderwoche", "Start", "Ende", "Alle Anrufe"]
    assert "Mobil Anrufer*innen" in shown and "TH Erstanrufer*innen" in shown


def test_map(spark):
    calls = makers.calls(
        spark,
        [
            {"state": "Berlin", "caller": "1"},
            {"state": "Berlin", "caller": "1", "success": False},
            {"state": "Bayern", "caller": "2", "first_call": True},
            {"state": None, "caller": "3"},
            {"state": "Bremen", "caller": "4", "is_landline": False},
            {"state": "Bremen", "caller": "5", "is_landline": None},
        ],
    )
    states = state_table(spark)
    counts = {
        row.state: (row.n, row.label_n)
        for row in state_reports.state_map(calls, states, "calls").collect()
    }
    assert len(counts) == 16
    assert counts["Berlin"] == (2, 2) and counts["Saarland"] == (None, 0)
    assert counts["Bremen"] == (None, 0)
    ok = state_reports.state_map(calls, states, "calls", only_success=True)
    assert ok.filter("state = 'Berlin'").first().n == 1
    totals = state_reports.mobile_and_landline(calls, "calls").first()
    assert tuple(totals) == (1, 3, 2)
    empty = state_reports.mobile_and_landline(calls, "calls", start="2030-01-01").first()
    assert tuple(empty) == (0, 0, 0)
    with pytest.raises(ValueError):
        state_reports.state_map(calls, states, "minutes")


def test_state_attributes(spark):
    table = spark.createDataFrame([("Berlin", "3"), ("Wien", "9")], "NAME_1 string, ID_1 string")
    joined = state_reports.state_attributes(table, state_table(spark))
    assert [tuple(row) for row in joined.collect()] == [("Berlin", "3", "BE")]


def test_hours_and_weekdays(spark):
    calls = makers.calls(
        spark,
        [
            {"call_date": "2024-03-10", "time_s": 8 * 3600 - 1},
            {"call_date": "2024-03-10", "time_s": 8 * 3600, "success": False},
            {"call_date": "2024-03-11", "time_s": 22 * 3600 - 1, "success": None},
            {"call_date": "2024-03-11", "time_s": 22 * 3600, "duration_in": 0},
        ],
    )
    days = patterns.calls_by_weekday(calls).orderBy("weekday_no").collect()
    assert [tuple(row) for row in days] == [(1, "Montag", 2), (7, "Sonntag", 2)]
    heat = patterns.heat_table(calls, *patterns.DAYTIME).orderBy("hour").collect()
    assert [(row.weekday, row.hour, row.n) for row in heat] == [
        ("Sonntag", 8, 1),
        ("Montag", 21, 1),
    ]
    failed = patterns.heat_table(calls, only_failed=True).collect()
    assert [(row.hour, row.n) for row in failed] == [(8, 1)]
    shares = {row.weekday: row for row in patterns.fail_share_by_weekday(calls).collect()}
    assert shares["Sonntag"].share_label == "50.00%"
    assert shares["Montag"].share == 0.0
    strict = patterns.successful_by_hour(calls, strict=True)
    assert sorted(row.hour for row in strict.collect()) == [7, 8, 21]
    assert sorted(row.hour for row in patterns.successful_by_hour(calls).collect()) == [7, 22]


def test_attempts(spark):
    rows = []
    for caller, count in (("a", 10), ("b", 11), ("c", 100), ("d", 1)):
        rows += [{"caller": caller, "success": caller == "c" and i == 0} for i in range(count)]
    calls = makers.calls(spark, rows)
    found = attempts.attempt_histogram(calls).collect()
    assert sorted(map(tuple, found)) == [(1, False, 1), (10, False, 1), (11, False, 1), (11, True, 1)]
    failed = attempts.attempt_histogram(calls, only_failed=True).collect()
    assert sorted(map(tuple, failed)) == [(1, False, 1), (10, False, 1), (11, False, 1)]
    # Caller-days 1, 10, 11, 100, interpolated between neighbours.
    quantiles = attempts.attempt_quantiles(calls).first()
    assert quantiles.p50 == 10.5 and quantiles.p75 == 33.25
    assert quantiles.p90 == pytest.approx(73.3)
    near = attempts.attempt_quantiles(calls, approx=True).first()
    assert near.p50 == 10


def test_attempts_count_unknown_success_as_none(spark):
    calls = makers.calls(spark, [{"success": None}, {"success": True}, {"caller": None}])
    found = attempts.with_attempts(calls)
    assert makers.by_id(found, "attempts", "successes") == {"1": (2, 1), "2": (2, 1), "3": (1, 1)}


def test_duplicates(spark):
    pair = [{"success": False, "module": "a"}, {"success": False, "module": "b"}]
    triple = [{"time_s": 1, "success": s} for s in (True, True, None)]
    calls = makers.calls(spark, pair + triple + [{"call_date": "2023-01-01"}])
    by_year = quality.duplicates_by_year(calls).collect()
    assert sorted(map(tuple, by_year)) == [(2023, 1, 1), (2024, 2, 2), (2024, 3, 3)]
    assert tuple(quality.duplicate_pairs(calls).first()) == (1.0, 2.5)
    assert [row.n for row in quality.worst_first(quality.duplicate_groups(calls)).collect()] == [
        3,
        2,
    ]
    table = quality.duplicate_crosstab(calls, F.col("success"), "success").collect()
    assert {row.success: (row.not_dup, row.dup) for row in table} == {
        True: (1, 2),
        False: (0, 2),
        None: (0, 1),
    }
    compared = quality.compare_duplicates(calls, calls.filter("time_s = 1")).collect()
    assert sorted(map(tuple, compared)) == [(2, 1, 0), (3, 1, 1)]
    assert sorted(makers.by_id(quality.with_multiplicity(calls), "n").values()) == [
        1,
        2,
        2,
        3,
        3,
        3,
    ]


def test_dedup(spark):
    calls = makers.calls(
        spark,
        [
            {"id": "1", "module": "a", "first_call": True},
            {"id": "r1", "module": "b", "first_call": False},
            {"id": "2", "time_s": 40000},
        ],
    )
    found = quality.remove_duplicate_calls(calls)
    assert sorted((row.time_s, row.first_call) for row in found.collect()) == [
        (36000, True),
        (40000, False),
    ]
    assert quality.remove_duplicate_calls(calls, strict=True).count() == 3
    assert quality.distinct_check(calls).first().ok
    repeated = calls.drop("id", "module")
    assert tuple(quality.distinct_check(repeated).first()) == (3, 2, False)
    with pytest.raises(ValueError, match="1 of 3 rows"):
        quality.assert_distinct(repeated)


def test_missing_days(spark):
    calls = makers.calls(spark, [{"call_date": f"2024-03-0{d}"} for d in (1, 2, 4)])
    assert [str(row.call_date) for row in quality.missing_days(calls).collect()] == ["2024-03-03"]
    with pytest.raises(ValueError, match="2024-03-03"):
        quality.assert_all_days(calls)
    quality.assert_all_days(calls.filter("call_date < '2024-03-04'"))


def test_box_and_six_numbers(spark):
    rows = []
    for day, count in enumerate([1, 2, 3, 4, 30], 1):
        rows += [{"call_date": f"2024-01-0{day}"}] * count
    calls = makers.calls(spark, rows)
    box = quality.daily_box_stats(calls).first()
    assert (box.q1, box.median, box.q3) == (2, 3, 4)
    assert (box.low_whisker, box.high_whisker, box.outliers) == (1, 4, 1)
    assert [row.n for row in quality.daily_outliers(calls).collect()] == [30]
    six = quality.six_numbers(quality.calls_per_day(calls), "n").first()
    assert tuple(six) == (1.0, 2.0, 3.0, 8.0, 4.0, 30.0)


def test_page(spark):
    table = spark.range(40).toDF("n")
    rows = page(table, 2, [F.desc("n")], ["n >= 5"]).collect()
    assert [row.n for row in rows] == list(range(24, 9, -1))
    assert page(table, 3, ["n"]).count() == 10


# Identities


def test_days_add_up_to_years(fact):
    days = period.period_report(fact, "day").groupBy().agg(F.sum("calls"), F.sum("calls_ok")).first()
    years = period.period_report(fact, "year").groupBy().agg(F.sum("calls"), F.sum("calls_ok")).first()
    assert tuple(days) == tuple(years)


def test_origins_add_up(spark, fact):
    report = origin.origin_report(fact, state_table(spark))
    totals = origin.pivot_origins(report).agg(F.sum("all_calls"), F.sum("all_first_callers")).first()
    assert totals[0] == fact.count()
    assert totals[1] == fact.select("caller").distinct().count()


@pytest.mark.parametrize("variable", state_reports.VARIABLES)
def test_states_mobile_and_unknown_add_up(spark, fact, variable):
    on_map = state_reports.state_map(fact, state_table(spark), variable).agg(F.sum("label_n")).first()[0]
    totals = state_reports.mobile_and_landline(fact, variable).first()
    everything = state_reports.count_by_label(fact, variable).agg(F.sum("n")).first()[0]
    assert on_map == totals.landline
    assert totals.mobile + totals.landline + totals.unknown == everything


# Reports as shown


@pytest.mark.parametrize("kind", ["day", "week", "month", "year", "origin"])
def test_shown_and_exported(spark, fact, tmp_path, kind):
    table = reports.shown(fact, kind, "1996-01-01", "1997-12-31")
    key = {"day": "Tag", "year": "Jahr"}.get(kind, "Start")
    keys = [row[key] for row in table.collect()]
    assert keys and keys == sorted(keys, reverse=True)
    path = reports.export(fact, kind, str(tmp_path), "1996-01-01", "1997-12-31")
    assert path.rsplit("/", 1)[1].split("_")[0].endswith("tabelle")
    assert spark.read.option("header", True).csv(path).count() == len(keys)


def test_unknown_report(fact):
    with pytest.raises(ValueError):
        reports.report(fact, "hour")
