"""S1-S13, R1, R2, P19 on files in a temporary folder."""

import datetime as dt
import json
import pathlib
import re
import shutil

import makers
import pyspark
import pytest
from compare import spark_bag
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ringlog.operators.first_call import mark_first_calls
from ringlog.operators.period import period_report
from ringlog.operators.refresh import known_before, last_day, refresh_calls
from ringlog.plans.tables import (
    Refresh,
    import_annual,
    index_callers,
    quarantine_path,
    refresh_table,
    split_legacy,
    staged,
)
from ringlog.schema import CALLS, FILE_COLUMNS
from ringlog.session import work_path
from ringlog.sources import files, samples, table
from ringlog.sources.callers import callers_path, first_days, has_callers
from ringlog.sources.export import export_report
from ringlog.sources.files import (
    read_annual,
    read_areas,
    read_legacy,
    read_state_attributes,
    read_states,
)
from ringlog.sources.landing import chunk_plan, parse_responses, read_responses
from ringlog.sources.synthetic import synthetic_calls, synthetic_table
from ringlog.sources.table import read_calls, replace_partitions, write_calls
from ringlog.streaming.follow import follow_landing

AREAS = [("004930", "Berlin", "Berlin", "10115"), ("004989", "München", "Bayern", "80331")]


def text(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


# Files


def test_annual_files_match_by_name(spark, tmp_path):
    text(
        tmp_path / "2020.csv",
        "date,id,time,caller,duration_inbound,duration_outbound,success,Ortsnetzkennzahl,"
        "Ortsnetzname,Bundesland,PLZ,firstcall,is_landline,extra\n"
        '2020-01-02,1,10:00:01,abc,5,6,TRUE,004930,"Ort ""x"", y",Berlin,01067,TRUE,TRUE,e\n'
        "2024-13-01,2,,abc,x,NA,NA,NA,,NA,NA,FALSE,maybe,\n",
    )
    text(
        tmp_path / "2021.csv",
        "caller,id,date,time,success,modul_name\nxyz,3,2021-05-06,23:59:59,F,Hotline\n",
    )
    calls = read_annual(spark, str(tmp_path))
    rows = {row.id: row.asDict() for row in calls.collect()}
    assert len(rows) == 3
    one, two, three = rows["1"], rows["2"], rows["3"]
    assert one["call_date"] == dt.date(2020, 1, 2) and one["time_s"] == 36001
    assert one["area_name"] == 'Ort "x", y' and one["plz"] == "01067" and one["extra"] == "e"
    assert one["module"] is None and one["first_call"] is True
    assert [two[c] for c in ("call_date", "time_s", "duration_in", "success", "is_landline")] == [
        None
    ] * 5
    assert two["area_name"] is None
    assert three["module"] == "Hotline" and three["success"] is False
    assert three["call_date"] == dt.date(2021, 5, 6) and three["state"] is None


def test_cells_with_line_breaks(spark, tmp_path):
    """A record is not a line; a byte order mark, blank lines and a repeated header are no records."""
    text(
        tmp_path / "a.csv",
        '\ufeff\n  \n"id","date",caller,Ortsnetzname\n1,2021-02-03,x,"Bad\nHomburg"\n\n'
        'id,date,caller,Ortsnetzname\n2,2021-02-04,"y ""z""",\n , ,,\n',
    )
    (tmp_path / "b.csv").write_bytes(b'caller,id,"Orts\nname"\r\n"a,\r\nb",3,n\r\n')
    rows = {row.id: row.asDict() for row in read_annual(spark, str(tmp_path)).collect()}
    assert {k: (r["caller"], r["area_name"]) for k, r in rows.items() if k} == {
        "1": ("x", "Bad\nHomburg"), "2": ('y "z"', None), "3": ("a,\r\nb", None)
    }
    old = text(tmp_path / "old.txt", 'a,b,c,d,e,f,g,h,i,j,k,l\n2020-01-02,10:00:00,abc,1,2,TRUE,FALSE,004930,"Bad\nX",Berlin,10115,TRUE\n')
    assert [row.area_name for row in read_legacy(spark, old).collect()] == ["Bad\nX"]


def test_many_files_of_few_kinds_are_scanned_once(spark, tmp_path, monkeypatch):
    for k in range(60):
        head = "id,date,caller" if k % 2 else "date,id,extra,caller"
        row = f"{k},2021-01-02,x" if k % 2 else f"2021-01-02,{k},e,x"
        text(tmp_path / f"{k}.csv", f"{head}\n{row}\n{row}\n")
    monkeypatch.setattr(files, "HEAD_BYTES", 8)
    found = read_annual(spark, str(tmp_path))
    assert sorted(int(row.id) for row in found.collect()) == sorted([*range(60)] * 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "Exchange" not in plan and "FileScan text" not in plan


def test_annual_needs_a_folder_with_files(spark, tmp_path):
    with pytest.raises(ValueError):
        read_annual(spark, "")
    with pytest.raises(FileNotFoundError):
        read_annual(spark, str(tmp_path))
    text(tmp_path / "2020.csv", "")
    with pytest.raises(FileNotFoundError):
        read_annual(spark, str(tmp_path))
    text(tmp_path / "2021.csv", "id,date\n1,2021-02-03\n")
    assert read_annual(spark, str(tmp_path)).count() == 1


def test_legacy_file_is_positional(spark, tmp_path):
    file = text(
        tmp_path / "old.csv",
        "a,b,c,d,e,f,g,h,i,j,k,l\n"
        "2020-01-02,10:00:00,abc,1,2,TRUE,FALSE,004930,Berlin,Berlin,10115,TRUE\n",
    )
    row = read_legacy(spark, file).first()
    assert (row.call_date, row.time_s, row.duration_out) == (dt.date(2020, 1, 2), 36000, 2)
    assert (row.is_landline, row.area_code, row.first_call) == (False, "004930", True)
    table = split_legacy(spark, file, str(tmp_path / "table"))
    assert [(row.year, row.first_call) for row in table.collect()] == [(2020, True)]


def test_lookup_files(spark, tmp_path):
    areas = read_areas(
        spark,
        text(
            tmp_path / "areas.csv",
            "PLZ,Ortsnetzkennzahl,Ortsnetzname,Bundesland\n01067,0049351,Dresden,Sachsen\n",
        ),
    )
    assert tuple(areas.first()) == ("0049351", "Dresden", "Sachsen", "01067")
    states = read_states(
        spark,
        text(
            tmp_path / "states.csv",
            "Bundesland,bl_short,lat_correct,lon_correct\nBayern,BY,-0.1,-0.2\n",
        ),
    )
    assert tuple(states.first()) == ("Bayern", "BY", -0.1, -0.2)
    attributes = read_state_attributes(
        spark, text(tmp_path / "attributes.csv", '"NAME_1","NL_NAME_1"\n"Bayern",NA\n')
    )
    assert tuple(attributes.first()) == ("Bayern", None)


def test_annual_roundtrip_and_import(spark, sf_dir, tmp_path):
    calls = mark_first_calls(samples.calls(spark, sf_dir))
    folder = str(tmp_path / "annual")
    write_calls(calls, folder, format="csv")
    again = read_annual(spark, folder)
    assert set(again.columns) == set(FILE_COLUMNS.values())
    assert spark_bag(again) == spark_bag(calls)
    table = import_annual(spark, folder, str(tmp_path / "table"), repair=True, by_day=False)
    assert spark_bag(table.drop("year")) == spark_bag(calls)


def test_import_with_a_legacy_column(spark, tmp_path):
    folder = tmp_path / "annual"
    folder.mkdir()
    text(
        folder / "2020.csv",
        "id,date,time,caller,Bundesland,landline\n1,2020-01-02,10:00:00,a,Thueringen,TRUE\n",
    )
    table = import_annual(
        spark, str(folder), str(tmp_path / "table"), repair=True, legacy_column="landline"
    )
    row = table.first()
    assert (row.is_landline, row.state, row.first_call) == (True, "Thüringen", True)


def test_files_are_sorted_and_years_pruned(spark, sf_dir, tmp_path):
    path = str(tmp_path / "table")
    write_calls(mark_first_calls(samples.calls(spark, sf_dir)), path)
    for file in sorted((tmp_path / "table").glob("year=1997/*.parquet")):
        rows = spark.read.parquet(str(file)).collect()
        keys = [(row.call_date, row.time_s, row.caller) for row in rows]
        assert keys == sorted(keys)
    some = read_calls(spark, path, "1997-03-01", "1997-03-31")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "PushedFilters: [IsNotNull(call_date), GreaterThanOrEqual(call_date" in plan


def test_table_by_day(spark, sf_dir, tmp_path, capsys):
    path = str(tmp_path / "table")
    calls = mark_first_calls(samples.calls(spark, sf_dir).filter("year(call_date) = 1997"))
    write_calls(calls, path, by_day=True)
    assert spark_bag(read_calls(spark, path).drop("year", "day")) == spark_bag(calls)
    one = read_calls(spark, path, "1997-03-04", "1997-03-05")
    wanted = calls.filter(F.col("call_date").between("1997-03-04", "1997-03-05"))
    assert spark_bag(one.drop("year", "day")) == spark_bag(wanted)
    one.explain("formatted")
    filters = re.search(r"PartitionFilters: (.*)", capsys.readouterr().out)[1]
    assert re.search(r"day#\d+ >= 1997-03-04.*day#\d+ <= 1997-03-05", filters)


def test_only_given_years_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    old = makers.calls(spark, [{"call_date": f"{y}-05-05"} for y in (2020, 2021, 2022)])
    write_calls(old, path)
    new = makers.calls(
        spark,
        [{"id": "n", "call_date": "2021-06-06"}, {"call_date": "2019-01-01"}, {"call_date": None}],
    )
    seen = Observation("write")
    write_calls(new, path, years=[2021, 2022], observe=seen)
    assert seen.get == {"rows_in": 3, "rows_without_date": 1, "rows_of_other_years": 1}
    assert sorted((row.year, row.id) for row in read_calls(spark, path).collect()) == [
        (2020, "1"),
        (2021, "n"),
        (2022, "3"),
    ]


def test_rows_without_id_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    write_calls(makers.calls(spark, [{}] * 50).drop("id"), path)
    assert read_calls(spark, path).count() == 50


def test_export(spark, tmp_path):
    calls = makers.calls(spark, [{"call_date": "2024-03-04"}, {"call_date": "2024-04-09"}])
    for kind, name in (
        ("week", "wochentabelle_2024-03-04_2024-04-09"),
        ("day", "tagestabelle_2024-03-04_2024-04-09"),
        ("year", "jahrestabelle_2024_2024"),
    ):
        path = export_report(period_report(calls, kind), str(tmp_path), kind)
        assert path == f"{tmp_path}/{name}"
        assert spark.read.option("header", True).csv(path).count() == (1 if kind == "year" else 2)


def test_work_path_is_shared(spark):
    assert work_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# Landing, chunks


def envelope(*rows):
    return json.dumps({"response": {"data": list(rows)}})


def api_row(**values):
    row = {
        "id": 1,
        "date": "2024-03-04",
        "time": "10:00:00",
        "service": "s",
        "caller": "0049301",
        "duration_inbound": 1,
        "duration_outbound": 2,
        "success": True,
    }
    return row | values


def test_responses(spark, tmp_path):
    text(tmp_path / "a.json", envelope(api_row(), api_row(id=2, date="2024-03-06")))
    text(tmp_path / "b.json", envelope())
    text(tmp_path / "c.json", '{"response": {"data": []}}')
    rows = read_responses(spark, str(tmp_path)).collect()
    assert sorted((row.id, row.success, row.duration_inbound) for row in rows) == [
        ("1", "true", "1"),
        ("2", "true", "1"),
    ]
    some = read_responses(spark, str(tmp_path), "2024-03-05", "2024-03-06")
    assert [row.id for row in some.collect()] == ["2"]


def test_broken_response_is_not_passed_over(spark, tmp_path):
    text(tmp_path / "a.json", envelope(api_row()))
    text(tmp_path / "b.json", envelope(api_row())[:40])
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        read_responses(spark, str(tmp_path)).collect()
    bodies = spark.createDataFrame([(envelope(api_row())[:40],)], "body string")
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        parse_responses(bodies, "body").collect()


def test_multi_line_response(spark, tmp_path):
    pretty = json.dumps(json.loads(envelope(api_row())), indent=2)
    text(tmp_path / "a.json", pretty)
    assert read_responses(spark, str(tmp_path), multi_line=True).count() == 1


@pytest.mark.parametrize(
    "counts",
    [
        {1: 50, 2: 60},
        {1: 40, 2: 40, 3: 40, 4: 40, 5: 40, 9: 40},
        {1: 10, 2: 95, 3: 10, 4: 250, 5: 10, 6: 10},
        {1: 500},
    ],
)
def test_chunks_cover_each_day_once(spark, counts):
    days = spark.createDataFrame(
        [(dt.date(2024, 1, d), n) for d, n in counts.items()], "call_date date, n int"
    )
    calls = days.select("call_date", F.explode(F.expr("sequence(1, n)")))
    plan = [row for row in chunk_plan(calls, limit=100, target=70).orderBy("chunk").collect()]
    covered = [
        row.start + dt.timedelta(i) for row in plan for i in range((row.stop - row.start).days + 1)
    ]
    assert covered == [dt.date(2024, 1, d) for d in range(min(counts), max(counts) + 1)]
    assert sum(row.n for row in plan) == sum(counts.values())
    assert all(row.n <= 100 or row.oversize for row in plan)
    assert [row.n for row in plan if row.oversize] == [n for n in counts.values() if n > 100]
    assert [row.chunk for row in plan] == list(range(1, len(plan) + 1))


def test_small_range_is_one_chunk(spark):
    calls = makers.calls(spark, [{"call_date": "2024-01-02"}])
    plan = chunk_plan(calls, "2024-01-01", "2024-01-31").collect()
    assert [(str(row.start), str(row.stop), row.n) for row in plan] == [
        ("2024-01-01", "2024-01-31", 1)
    ]


# Refresh


def test_history_is_cut_to_those_who_call_again(spark, stored, tmp_path):
    calls = makers.calls(spark, [{"call_date": "2023-12-31"}])
    fetched = staged(spark, calls, str(tmp_path / "fetched"))
    plan = known_before(read_calls(spark, stored), fetched, dt.date(2023, 12, 31))
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    semi = plan.index("Join LeftSemi")
    assert "Aggregate" not in plan[semi : plan.index("Relation", semi)]


def test_refresh_replaces_the_last_day(spark):
    stored = mark_first_calls(
        makers.calls(
            spark,
            [
                {"id": "1", "caller": "a", "call_date": "2024-03-04"},
                {"id": "2", "caller": "b", "call_date": "2024-03-05"},
                {"id": "0", "caller": "z", "call_date": None},
            ],
        )
    ).cache()
    fetched = makers.calls(
        spark,
        [
            {"id": "2", "caller": "b", "call_date": "2024-03-05"},
            {"id": "3", "caller": "a", "call_date": "2024-03-05", "time_s": 1},
            {"id": "4", "caller": "c", "call_date": "2024-03-06"},
            {"id": "9", "caller": "c", "call_date": "2024-03-07"},
        ],
    )
    assert last_day(stored) == dt.date(2024, 3, 5)
    wanted = {"1": True, "2": True, "3": False, "4": True}
    once = refresh_calls(stored, fetched, stop="2024-03-06").cache()
    assert makers.by_id(once, "first_call") == wanted
    again = refresh_calls(once, fetched, stop="2024-03-06")
    assert makers.by_id(again, "first_call") == wanted
    anew = refresh_calls(stored, fetched, stop="2024-03-06", recompute=True)
    assert spark_bag(anew) == spark_bag(once)


def test_empty_refresh_changes_nothing(spark):
    stored = mark_first_calls(makers.calls(spark, [{}, {"caller": None}])).cache()
    nothing = makers.calls(spark, [{}]).limit(0)
    assert spark_bag(refresh_calls(stored, nothing)) == spark_bag(stored)


def test_refresh_of_an_empty_table(spark):
    fetched = makers.calls(spark, [{}, {"id": "2", "time_s": 1}])
    found = refresh_calls(fetched.limit(0), fetched)
    assert makers.by_id(found, "first_call") == {"1": False, "2": True}


@pytest.fixture(params=[False, True], ids=["by year", "by day"])
def stored(request, spark, tmp_path):
    path = str(tmp_path / "table")
    calls = makers.calls(
        spark,
        [
            {"id": "1", "call_date": "2022-12-30", "caller": "x"},
            {"id": "2", "call_date": "2023-12-30"},
            {"id": "3", "call_date": "2023-12-31"},
        ],
    )
    write_calls(mark_first_calls(calls), path, by_day=request.param)
    return path


def batch(spark):
    return makers.records(
        spark,
        [
            {"id": "2", "date": "2023-12-30"},
            {"id": "3", "date": "2023-12-31"},
            {"id": "4", "date": "2023-12-31", "caller": "0049891"},
            {"id": "5", "date": "2024-01-01", "caller": None},
            {"id": "6", "date": "2024-01-02", "caller": "00491511"},
            {"id": "7", "date": "2024-01-09", "caller": "00491511"},
        ],
    )


def untouched(path):
    return {file.name: file.stat().st_mtime_ns for file in path.glob("year=2022/**/*")}


def test_refresh_of_the_table_on_disk(spark, stored, tmp_path):
    areas = makers.areas(spark, AREAS)
    before = untouched(tmp_path / "table")
    first = refresh_table(spark, stored, batch(spark), areas, "2024-01-05")
    assert first == Refresh(dt.date(2023, 12, 30), 4, 0, 1, 1, 0)
    once = spark_bag(read_calls(spark, stored))
    rows = {row.id: row for row in read_calls(spark, stored).collect()}
    assert set(rows) == {"1", "2", "3", "4", "6"}
    assert rows["4"].state == "Bayern" and rows["4"].first_call and rows["4"].year == 2023
    assert len(rows["4"].caller) == 64
    assert rows["6"].year == 2024
    assert untouched(tmp_path / "table") == before

    again = refresh_table(spark, stored, batch(spark), areas, "2024-01-05")
    assert again == first
    assert spark_bag(read_calls(spark, stored)) == once


def test_refresh_without_records(spark, stored):
    before = spark_bag(read_calls(spark, stored))
    areas = makers.areas(spark, AREAS)
    nothing = refresh_table(spark, stored, batch(spark).limit(0), areas, "2024-01-05")
    assert nothing == Refresh(None, 0, 0, 0, 0, 0)
    assert spark_bag(read_calls(spark, stored)) == before


def test_failed_refresh_leaves_the_table(spark, stored):
    before = spark_bag(read_calls(spark, stored))
    areas = makers.areas(spark, AREAS[:1])
    with pytest.raises(Exception, match="exactly one area"):
        refresh_table(spark, stored, batch(spark), areas, "2024-01-05")
    assert spark_bag(read_calls(spark, stored)) == before


@pytest.mark.parametrize("by_day", [False, True])
def test_last_day_that_is_fetched_empty(spark, tmp_path, by_day):
    path = str(tmp_path / "table")
    calls = makers.calls(spark, [{"id": "1", "call_date": "2022-06-01"}, {"call_date": "2023-01-01"}])
    write_calls(mark_first_calls(calls), path, by_day=by_day)
    late = makers.records(spark, [{"id": "5", "date": "2024-01-02"}])
    covered = ("2023-01-01", "2024-01-05")
    refresh_table(spark, path, late, makers.areas(spark, AREAS), "2024-01-05", covered)
    assert sorted((row.id, row.year) for row in read_calls(spark, path).collect()) == [
        ("1", 2022),
        ("5", 2024),
    ]


def test_replacing_can_be_repeated(spark, stored, tmp_path):
    by_day = "day" in read_calls(spark, stored).columns
    new = makers.calls(spark, [{"id": "7", "call_date": "2023-12-31"}, {"id": "8", "call_date": "2024-01-01"}])
    write_calls(mark_first_calls(new), str(tmp_path / "new"), by_day=by_day)
    for _ in range(2):
        replace_partitions(spark, str(tmp_path / "new"), stored, [dt.date(2023, 12, 30)])
        ids = sorted(row.id for row in read_calls(spark, stored).collect())
        assert ids == ["1", "7", "8"]


def test_years_only_replaces_their_days(spark, tmp_path):
    path = str(tmp_path / "table")
    old = [{"id": str(k), "call_date": f"202{k}-01-0{k}"} for k in (1, 2, 3)]
    write_calls(makers.calls(spark, old), path)
    write_calls(makers.calls(spark, [{"id": "9", "call_date": "2022-05-05"}]), path, years=[2022, 2024])
    assert sorted(row.id for row in read_calls(spark, path).collect()) == ["1", "3", "9"]


def test_files_of_several_schemas(spark, tmp_path):
    """Files that lack columns are read with nulls, and no column is lost."""
    path = str(tmp_path / "table")
    bare = makers.calls(spark, [{"id": None, "call_date": "2022-01-01"}]).drop("id", "module", "plz")
    write_calls(bare, path)
    write_calls(makers.calls(spark, [{"id": "2", "call_date": "2023-01-01"}]), path, years=[2023])
    found = read_calls(spark, path)
    assert found.columns[:-2] == CALLS.names
    assert {row.id for row in found.collect()} == {None, "2"}


def test_records_are_counted_not_lost(spark, stored, tmp_path):
    areas = makers.areas(spark, AREAS)
    records = makers.records(
        spark,
        [
            {"id": "10", "date": "2024/01/02"}, {"id": "11", "date": "2024.01.02", "time": "12:30"},
            {"id": "12", "date": "02.01.2024"}, {"id": "13", "date": "2024-01-02", "caller": None},
            {"id": "14", "date": "2024-01-02", "caller": "0049777"},
        ],
    )
    for _ in range(2):
        done = refresh_table(spark, stored, records, areas, "2024-01-05", on_bad="flag")
        assert done == Refresh(dt.date(2024, 1, 2), 2, 1, 1, 0, 1)
        ids = {row.id for row in read_calls(spark, stored).collect()}
        assert ids == {"1", "2", "3", "10", "11"}
        aside = spark.read.parquet(quarantine_path(stored)).collect()
        assert [(row.id, row.area_matches) for row in aside] == [("14", 0)]
    shared = spark.conf.get("spark.checkpoint.dir")
    assert not list(pathlib.Path(shared).glob("stage-*"))


def test_follow_landing(spark, stored, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    areas = makers.areas(spark, AREAS)

    def run():
        query = follow_landing(
            spark, str(landing), stored, areas, "2024-01-31", str(tmp_path / "checkpoint")
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return {row.id: row.first_call for row in read_calls(spark, stored).collect()}

    three = api_row(id="3", date="2023-12-31")
    four = api_row(id="4", date="2024-01-01", caller="0049892")
    text(landing / "1.json", envelope(three, four))
    text(landing / "2.json", envelope(four))
    assert run() == {"1": True, "2": True, "3": True, "4": True}
    text(landing / "3.json", envelope(four, api_row(id="5", date="2024-01-02", caller="0049892")))
    assert run() == {"1": True, "2": True, "3": True, "4": True, "5": False}
    assert set(run()) == {"1", "2", "3", "4", "5"}
    # A file with a later day only, and one with an earlier day, take nothing away.
    text(landing / "4.json", envelope(api_row(id="6", date="2024-01-03", caller="0049893")))
    assert set(run()) == {"1", "2", "3", "4", "5", "6"}
    text(landing / "5.json", envelope(api_row(id="0", date="2023-12-31", caller="0049893", time="01:00:00")))
    late = run()
    assert set(late) == {"0", "1", "2", "3", "4", "5", "6"}
    assert late["0"] and not late["6"]


def test_records_that_came_before_cost_no_rewrite(spark, stored, tmp_path):
    landing, areas = tmp_path / "landing", makers.areas(spark, AREAS)
    landing.mkdir()

    def run():
        query = follow_landing(
            spark, str(landing), stored, areas, "2024-01-31", str(tmp_path / "checkpoint")
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return {row.id: row.duration_in for row in read_calls(spark, stored).collect()}

    def written():
        files = (tmp_path / "table").glob("**/*.parquet")
        return {str(file): file.stat().st_mtime_ns for file in files}

    seven = api_row(id="7", date="2024-01-04", caller="0049894", duration_inbound="10")
    text(landing / "1.json", envelope(seven, seven))
    assert run()["7"] == 10
    before = written()
    text(landing / "2.json", envelope(seven))
    assert run()["7"] == 10 and written() == before
    # A corrected record is another one, and a call of long ago is not too late.
    text(landing / "3.json", envelope(api_row(id="7", date="2024-01-04", caller="0049894", duration_inbound="11")))
    text(landing / "4.json", envelope(api_row(id="8", date="2022-01-01", caller="0049894", duration_inbound="12")))
    found = run()
    assert found["7"] == 11 and found["8"] == 12
    state = [f for f in (tmp_path / "checkpoint" / "state").glob("**/*") if f.is_file()]
    assert state and not any(b"0049894" in file.read_bytes() for file in state)


# Made-up calls


def test_synthetic(spark):
    areas = makers.areas(spark, AREAS)
    calls = synthetic_table(spark, areas, 2000).cache()
    assert calls.count() == 2000
    row = calls.agg(
        F.min("call_date").alias("first"),
        F.max("call_date").alias("last"),
        F.avg(F.col("success").cast("int")).alias("success"),
        F.avg(F.col("is_landline").cast("int")).alias("landline"),
        F.max("duration_in").alias("longest"),
        F.count_distinct("area_code").alias("areas"),
    ).first()
    assert dt.date(2020, 1, 1) <= row.first and row.last <= dt.date(2025, 8, 8)
    assert 0.57 < row.success < 0.65 and 0.51 < row.landline < 0.59
    assert row.longest < 2000 and row.areas == 2
    numbers = spark.range(2000).withColumnRenamed("id", "n").repartition(7)
    assert spark_bag(synthetic_calls(numbers, areas)) == spark_bag(calls)


# Replacements that break off, and the index of callers


def folders(path):
    """What is beside a table, but for its index of callers."""
    return sorted(f.name for f in path.iterdir() if f.name.startswith("table-") and not f.name.endswith("-callers"))


def as_recomputed(spark, stored):
    """The table with first calls marked anew from the whole history."""
    calls = read_calls(spark, stored)
    marked = mark_first_calls(calls.drop("first_call")).select(calls.columns)
    return spark_bag(marked)


@pytest.mark.parametrize("at", [0, 1, 2])
def test_broken_replacement_is_finished(spark, stored, tmp_path, monkeypatch, at):
    """Broken off before the first year, between years, or before the index of callers."""
    areas = makers.areas(spark, AREAS)
    shutil.copytree(stored, tmp_path / "other")
    refresh_table(spark, str(tmp_path / "other"), batch(spark), areas, "2024-01-05")
    want = spark_bag(read_calls(spark, str(tmp_path / "other")))
    seen = []
    write, index = pyspark.sql.DataFrameWriter.parquet, table.replace_callers

    def parquet(self, path, *args, **options):
        if path == stored:
            seen.append(path)
            if len(seen) > at:
                raise OSError("lost")
        return write(self, path, *args, **options)

    def lost(*args):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(pyspark.sql.DataFrameWriter, "parquet", parquet)
        broken.setattr(table, "replace_callers", lost)
        with pytest.raises(OSError, match="lost"):
            refresh_table(spark, stored, batch(spark), areas, "2024-01-05")
    assert folders(tmp_path) == ["table-replacing"]
    assert spark_bag(read_calls(spark, stored)) == want
    nothing = refresh_table(spark, stored, batch(spark).limit(0), areas, "2024-01-05")
    assert nothing.calls == 0 and folders(tmp_path) == []
    assert spark_bag(read_calls(spark, stored)) == want == as_recomputed(spark, stored)
    refresh_table(spark, stored, batch(spark), areas, "2024-01-05")
    assert spark_bag(read_calls(spark, stored)) == want


def test_failed_refresh_leaves_no_number_in_plain(spark, stored, tmp_path):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    records = makers.records(spark, [{"id": "1", "caller": "0049777123", "date": "2024-01-02"}])
    with pytest.raises(Exception, match="exactly one area"):
        refresh_table(spark, stored, records, makers.areas(spark, AREAS), "2024-01-05")
    assert set(shared.iterdir()) == before and folders(tmp_path) == []
    seen = []
    write = pyspark.sql.DataFrameWriter.parquet

    def parquet(self, path, *args, **options):
        seen.append(self._df)
        return write(self, path, *args, **options)

    records = makers.records(spark, [{"id": "1", "caller": "0049301234567", "date": "2024-01-02"}])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pyspark.sql.DataFrameWriter, "parquet", parquet)
        refresh_table(spark, stored, records, makers.areas(spark, AREAS), "2024-01-05")
    assert seen and not any("0049301234567" in str(frame.collect()) for frame in seen[:2])


def test_refresh_reads_no_call_before_its_first_day(spark, tmp_path):
    """Earlier partitions may be unreadable: who called before is in the index."""
    path = str(tmp_path / "table")
    rows = [
        {"id": str(k), "call_date": f"2023-01-{k + 1:02}", "caller": None if k % 5 == 0 else f"c{k % 7}"}
        for k in range(20)
    ]
    write_calls(mark_first_calls(makers.calls(spark, rows)), path)
    index_callers(spark, path)
    want = {row.id: row.first_call for row in read_calls(spark, path).collect()}
    for folder in sorted((tmp_path / "table" / "year=2023").iterdir())[:15]:
        for file in folder.glob("*.parquet"):
            file.write_bytes(b"gone")
    records = makers.records(spark, [{"id": "99", "caller": "0049301", "date": "2023-01-18"}])
    refresh_table(spark, path, records, makers.areas(spark, AREAS), "2023-02-01")
    found = {row.id: row.first_call for row in read_calls(spark, path, "2023-01-16").collect()}
    assert found == {k: v for k, v in want.items() if int(k) > 14} | {"99": True}


def test_index_follows_refreshes(spark, stored):
    """Calls that go take their callers along; the index is as if made from the table."""
    areas = makers.areas(spark, AREAS)

    def index():
        rows = spark.read.parquet(callers_path(stored)).collect()
        return sorted(((row.caller or "", row.first_day) for row in rows))

    def made():
        rows = first_days(read_calls(spark, stored)).collect()
        return sorted(((row.caller or "", row.first_day) for row in rows))

    one = makers.records(spark, [{"id": "20", "caller": "0049305", "date": "2024-01-02"}])
    refresh_table(spark, stored, one, areas, "2024-01-05")
    assert index() == made()
    two = makers.records(spark, [{"id": "21", "caller": "0049306", "date": "2023-06-01"}])
    refresh_table(spark, stored, two, areas, "2024-01-05", ("2023-01-01", "2024-01-05"))
    assert index() == made() and as_recomputed(spark, stored) == spark_bag(read_calls(spark, stored))
    some = read_calls(spark, stored)
    new = makers.calls(spark, [{"id": "30", "call_date": "2023-02-03"}])
    write_calls(new, stored, years=[2023], by_day="day" in some.columns)
    assert not has_callers(spark, stored)
