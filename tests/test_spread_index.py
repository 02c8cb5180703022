"""Quantiles from days that add up, and responses found by an index."""

import datetime as dt
import json

import makers
import pytest
from compare import spark_bag
from pyspark.sql import functions as F

from ringlog.operators import attempts, quality, spread
from ringlog.sources.landing import index_responses, read_responses


def rank_bounds(values, value):
    """The share of values below it, and the share of those up to it."""
    return sum(v < value for v in values) / len(values), sum(v <= value for v in values) / len(values)


@pytest.fixture(scope="module")
def many_calls(spark):
    """40,000 calls on 60 days, with talk times that rarely repeat."""
    k = F.col("id")
    return spark.range(40_000).select(
        k.cast("string").alias("id"),
        F.date_add(F.lit("2023-12-01").cast("date"), (k % 60).cast("int")).alias("call_date"),
        F.when(k % 9 > 0, F.pmod(F.xxhash64(k), F.lit(700)).cast("string")).alias("caller"),
        F.pmod(F.xxhash64(k * 3), F.lit(100_000)).cast("int").alias("duration_out"),
        (k % 4 > 0).alias("success"),
    )


def test_ranks_within_the_bound(spark, many_calls, tmp_path):
    spread.day_spread(many_calls).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    found = spread.six_numbers(days, "year")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "/days" in plan and "Range" not in plan
    rows = {row.year: row for row in found.collect()}
    assert set(rows) == {2023, 2024}
    for year, row in rows.items():
        chosen = many_calls.filter((F.year("call_date") == year) & F.col("success"))
        values = [r.duration_out for r in chosen.select("duration_out").collect()]
        assert (row.minimum, row.maximum) == (min(values), max(values))
        assert row.mean == pytest.approx(sum(values) / len(values))
        for name, rank in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            below, upto = rank_bounds(values, row[name])
            assert below - 2 * spread.RANK_ERROR <= rank <= upto + 2 * spread.RANK_ERROR
    values = [r.attempts for r in attempts.caller_days(many_calls).collect()]
    row = spread.attempt_quantiles(days).first()
    for name, rank in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9)):
        below, upto = rank_bounds(values, row[name])
        assert below - 2 * spread.RANK_ERROR <= rank <= upto + 2 * spread.RANK_ERROR


def test_parts_add_up(many_calls):
    """Days that come in parts, as from two tables with days of their own, give the same rows."""
    early, late = (many_calls.filter(f"call_date {sign} '2024-01-05'") for sign in ("<", ">="))
    parts = spread.day_spread(early).union(spread.day_spread(late))
    whole = spread.day_spread(many_calls)
    assert spark_bag(spread.box_stats(parts)) == spark_bag(quality.daily_box_stats(many_calls))
    exact = ["year", "minimum", "mean", "maximum"]
    assert spark_bag(spread.six_numbers(parts, "year").select(exact)) == spark_bag(
        spread.six_numbers(whole, "year").select(exact)
    )


def test_few_values_are_exact(spark):
    """Nulls everywhere, days without a success, and a period."""
    rows = [
        {"id": "1", "call_date": "2024-03-01", "duration_out": 10, "success": True},
        {"id": "2", "call_date": "2024-03-01", "duration_out": 30, "success": True},
        {"id": "3", "call_date": "2024-03-02", "duration_out": 99, "success": False},
        {"id": "4", "call_date": "2024-03-02", "duration_out": None, "success": True},
        {"id": "5", "call_date": "2024-03-03", "duration_out": 20, "success": True, "caller": None},
        {"id": "6", "call_date": "2024-03-03", "duration_out": 7, "success": None, "caller": None},
        {"id": "7", "call_date": None, "duration_out": 5, "success": True},
    ]
    days = spread.day_spread(makers.calls(spark, rows))
    assert {r.call_date.day: (r.n, r.talks) for r in days.collect()} == {1: (2, 2), 2: (2, None), 3: (2, 1)}
    assert spread.six_numbers(days).first()[:] == (10, 10, 20, 20, 30, 30)
    assert spread.six_numbers(days, None, "2024-03-02", "2024-03-02").first()[:] == (None,) * 6
    assert spread.attempt_quantiles(days, "month").first()[:] == (2024, 3, 2, 2, 2)
    assert spread.attempt_quantiles(days.limit(0)).first()[:] == (None, None, None)
    assert spread.attempt_quantiles(days.limit(0), "year").count() == 0


# Responses


def put(folder, name, *days):
    data = [{"id": f"{name}-{k}", "date": day, "caller": "0049"} for k, day in enumerate(days)]
    (folder / name).write_text(json.dumps({"response": {"data": data}}) + "\n", encoding="utf-8")


def found(frame):
    return sorted((row.id, row.date) for row in frame.collect())


def test_only_files_of_the_range_are_opened(spark, tmp_path):
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    for k in range(20):
        day = dt.date(2024, 1, 1) + dt.timedelta(10 * k)
        put(folder, f"r {k}[x].json", *(str(day + dt.timedelta(j)) for j in range(10)))
    put(folder, "none.json")
    put(folder, "odd.json", "2024-13-01", None)
    assert index_responses(spark, str(folder), index) == 22
    assert index_responses(spark, str(folder), index) == 0
    for bounds in (("2024-01-15", "2024-02-03"), ("2024-06-30", None), (None, "2024-01-01"), ("2030-01-01", None)):
        some = read_responses(spark, str(folder), *bounds, index=index)
        assert found(some) == found(read_responses(spark, str(folder), *bounds))
    some = read_responses(spark, str(folder), "2024-01-15", "2024-02-03", index=index)
    assert len(some.inputFiles()) == 3 and len(some.columns) == 11
    whole = read_responses(spark, str(folder), index=index)
    assert found(whole) == found(read_responses(spark, str(folder))) and whole.count() == 202


def test_new_and_changed_files_are_not_missed(spark, tmp_path):
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    put(folder, "a.json", "2024-01-01")
    put(folder, "b.json", "2024-02-01")
    assert index_responses(spark, str(folder), index) == 2
    put(folder, "c.json", "2024-03-01", "2024-02-02")
    put(folder, "a.json", "2024-02-03", "2024-02-04")
    some = read_responses(spark, str(folder), "2024-02-01", "2024-02-28", index=index)
    assert {row.date for row in some.collect()} == {f"2024-02-0{k}" for k in range(1, 5)}
    assert index_responses(spark, str(folder), index) == 2
    some = read_responses(spark, str(folder), "2024-03-01", index=index)
    assert len(some.inputFiles()) == 1 and [row.date for row in some.collect()] == ["2024-03-01"]


def test_a_broken_file_is_not_indexed(spark, tmp_path):
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    put(folder, "a.json", "2024-01-01")
    (folder / "b.json").write_text('{"response": {"da', encoding="utf-8")
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        index_responses(spark, str(folder), index)
    put(folder, "b.json", "2024-01-02")
    assert index_responses(spark, str(folder), index) == 2
    assert read_responses(spark, str(folder), "2024-01-02", index=index).count() == 1
