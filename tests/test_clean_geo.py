"""P1-P5, J1 with its edge cases, J5, J6."""

import hashlib

import makers
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ringlog.operators import clean, geo

AREAS = [
    ("004930", "Berlin", "Berlin", "10115, 10117"),
    ("0049228", "Bonn", "Nordrhein-Westfalen", "53111"),
    ("004934202", "Delitzsch", "Sachsen", "04509"),
    ("0049355", "Cottbus", "Brandenburg", "03042"),
]


@pytest.fixture(scope="module")
def table(spark):
    return makers.areas(spark, AREAS)


def numbers(spark, *callers):
    rows = [{"id": str(i), "caller": c} for i, c in enumerate(callers, 1)]
    return clean.add_is_landline(makers.records(spark, rows).select("id", "caller"))


def test_landline(spark):
    found = numbers(spark, None, "0049151", "49151", "0049800123", "49800123", "0049301", "4930")
    assert list(makers.by_id(found, "is_landline").values()) == [
        None,
        False,
        False,
        False,
        False,
        True,
        True,
    ]


def test_each_number_finds_its_code(spark, table):
    found = geo.attach_area(
        numbers(spark, "004930777", "0049228777", "004934202777", "0049355777", "00491517"), table
    )
    assert makers.by_id(found, "area_code", "area_name", "state", "plz") == {
        "1": AREAS[0],
        "2": AREAS[1],
        "3": AREAS[2],
        "4": AREAS[3],
        "5": (None, None, None, None),
    }


def test_short_number_stays_one_row(spark, table):
    found = geo.attach_area(numbers(spark, "0049228"), table).collect()
    assert [(row.area_code, row.area_name) for row in found] == [("0049228", "Bonn")]


def test_nested_codes(spark, table):
    nested = table.union(makers.areas(spark, [("0049301", "Elsewhere", None, None)]))
    calls = numbers(spark, "0049301234")
    with pytest.raises(Exception, match="exactly one area"):
        geo.attach_area(calls, nested).collect()
    lenient = geo.attach_area(calls, nested, on_bad="null").first()
    assert lenient.area_code == "0049301"
    good, bad = geo.split_area_matches(geo.attach_area(calls, nested, on_bad="flag"))
    assert good.count() == 0
    assert bad.first().area_matches == 2


def test_nested_codes_of_one_name_are_one_row(spark, table):
    nested = table.union(makers.areas(spark, [("0049301", "Berlin", "Berlin", "x")]))
    found = geo.attach_area(numbers(spark, "0049301234"), nested).collect()
    assert [row.area_code for row in found] == ["0049301"]


def test_code_listed_twice(spark, table):
    same = table.union(table)
    assert geo.attach_area(numbers(spark, "004930777"), same).count() == 1
    other = table.union(makers.areas(spark, [("004930", "Potsdam", None, None)]))
    flagged = geo.attach_area(numbers(spark, "004930777"), other, on_bad="flag")
    assert flagged.first().area_matches == 2


def test_match_at_every_length(spark):
    all_lengths = makers.areas(
        spark, [(code, "A", None, None) for code in ("004930", "0049301", "00493012", "004930123")]
    )
    flagged = geo.attach_area(numbers(spark, "004930123456"), all_lengths, on_bad="flag")
    assert flagged.first().area_matches == 1


def test_unmatched(spark, table):
    calls = numbers(spark, "4930123456", "004999999", "00491511")
    with pytest.raises(Exception, match="exactly one area"):
        geo.attach_area(calls, table).count()
    assert geo.attach_area(calls, table, on_bad="null").count() == 3
    good, bad = geo.split_area_matches(geo.attach_area(calls, table, on_bad="flag"))
    assert sorted(makers.by_id(bad, "area_matches").items()) == [("1", 0), ("2", 0)]
    assert list(makers.by_id(good, "area_code").items()) == [("3", None)]
    with pytest.raises(ValueError, match="without an area: 2 landline numbers"):
        geo.assert_area_matches(calls, table)


def test_area_without_name_is_no_match(spark, table):
    nameless = makers.areas(spark, [("0049777", None, "Bayern", None)])
    flagged = geo.attach_area(numbers(spark, "00497771"), table.union(nameless), on_bad="flag")
    row = flagged.first()
    assert (row.area_matches, row.area_code) == (0, None)


def test_column_subset_and_unknown_mode(spark, table):
    found = geo.attach_area(numbers(spark, "004930777"), table, ["area_name", "state"])
    assert found.columns == ["id", "caller", "is_landline", "area_code", "area_name", "state"]
    only_state = geo.attach_area(numbers(spark, "004930777"), table, ["state"]).first()
    assert only_state.state == "Berlin"
    with pytest.raises(ValueError):
        geo.attach_area(numbers(spark, "004930777"), table, on_bad="ignore")


def test_prefix_join_shuffles_no_calls(spark, table):
    calls = numbers(spark, "004930777")
    plan = geo.attach_area(calls, table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 4
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan


def test_code_anywhere(spark, table):
    calls = numbers(spark, "004930777", "00491004930", "0049228004930", "00491511", None, "12")
    found = geo.attach_area_anywhere(calls, table)
    assert sorted((row.id, row.area_code) for row in found.collect() if row.area_code) == [
        ("1", "004930"),
        ("2", "004930"),
        ("3", "0049228"),
        ("3", "004930"),
    ]
    assert found.count() == 7
    landline = geo.attach_area_anywhere(calls, table, landline_only=True)
    assert makers.by_id(landline.filter("id = '2'"), "area_code") == {"2": None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates(spark):
    found = geo.prefix_candidates(numbers(spark, "0049301234", "0049301234", "00491511"))
    assert sorted((row.prefix_length, row.area_code) for row in found.collect()) == [
        (6, "004930"),
        (7, "0049301"),
        (8, "00493012"),
        (9, "004930123"),
    ]


def test_clean(spark, table):
    raw = makers.records(
        spark,
        [
            {"id": "1"},
            {"id": "2", "caller": None},
            {"id": "3", "caller": "004915112345"},
            {"id": "4", "date": "2024-13-01", "time": "", "success": "NA", "duration_inbound": "x"},
        ],
    )
    seen = Observation("cleaning")
    found = clean.clean_calls(raw, table, observe=seen)
    rows = {row.id: row for row in found.collect()}
    assert set(rows) == {"1", "3", "4"}
    assert seen.get == {"rows_in": 4, "rows_without_number": 1}
    assert "service" not in found.columns and "module" in found.columns
    assert rows["1"].caller == hashlib.sha256(b"004930123456").hexdigest()
    assert rows["1"].time_s == 36000 and rows["1"].state == "Berlin"
    assert rows["3"].is_landline is False and rows["3"].area_code is None
    dirty = rows["4"]
    assert [dirty.call_date, dirty.time_s, dirty.success, dirty.duration_in] == [None] * 4


def test_salt(spark):
    raw = makers.records(spark, [{"caller": "1"}, {"caller": None}])
    hashed = [row.caller for row in clean.hash_column(raw, salt="s").collect()]
    assert hashed == [hashlib.sha256(b"s1").hexdigest(), None]


def test_umlauts_and_legacy_column(spark):
    states = spark.createDataFrame([("Thueringen",), (None,), ("Bayern",)], "state string")
    repaired = [row.state for row in clean.repair_umlauts(states).collect()]
    assert repaired == ["Thüringen", None, "Bayern"]
    old = spark.createDataFrame([(True,)], "landline boolean")
    assert clean.adopt_legacy_column(old).first().is_landline is True


def test_projection_and_redundant(spark):
    raw = makers.records(spark, [{}]).withColumn("extra", F.lit(1)).drop("tarif")
    assert "extra" not in clean.select_api_fields(raw).columns
    assert clean.drop_redundant(raw).columns[-1] == "extra"


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2024-03-04", "2024-03-04"),
        (" 2024-3-4 ", "2024-03-04"),
        ("20240304", "2024-03-04"),
        ("2023-02-29", None),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, day):
    frame = spark.createDataFrame([(text,)], "t string")
    found = frame.select(clean.typed("call_date", F.col("t")).alias("d")).first().d
    assert (found and found.isoformat()) == day


@pytest.mark.parametrize(
    ("text", "seconds"),
    [
        ("00:00:00", 0),
        ("23:59:59", 86399),
        ("8:05:07", 29107),
        ("10:00:00.5", 36000),
        ("24:00:00", None),
        ("10:60:00", None),
        ("noon", None),
        ("NA", None),
    ],
)
def test_clock(spark, text, seconds):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(clean.typed("time_s", F.col("t")).alias("s")).first().s == seconds
