"""W1 and what it is built on."""

import datetime as dt
import random

import makers
import pytest
from compare import spark_bag
from pyspark.sql import Window
from pyspark.sql import functions as F

from ringlog.operators import groups
from ringlog.operators.first_call import mark_first_calls


def window_form(calls):
    order = Window.partitionBy("caller").orderBy(
        F.asc_nulls_last("call_date"), F.asc_nulls_last("time_s"), F.length("id"), "id"
    )
    return calls.withColumn("first_call", F.row_number().over(order) == 1)


def test_tie_goes_to_the_smaller_id(spark):
    marked = mark_first_calls(makers.calls(spark, [{"id": "10"}, {"id": "9"}]))
    assert makers.by_id(marked, "first_call") == {"10": False, "9": True}


def test_withheld_numbers_are_one_caller(spark):
    calls = makers.calls(
        spark, [{"caller": None, "time_s": 5}, {"caller": None, "time_s": 4}, {"caller": "1"}]
    )
    assert makers.by_id(mark_first_calls(calls), "first_call") == {"1": False, "2": True, "3": True}


def test_calls_without_date_or_time_come_last(spark):
    calls = makers.calls(
        spark,
        [
            {"call_date": None},
            {"time_s": None},
            {},
            {"caller": "2", "call_date": None, "time_s": None},
        ],
    )
    assert makers.by_id(mark_first_calls(calls), "first_call") == {
        "1": False,
        "2": False,
        "3": True,
        "4": True,
    }


def test_same_as_the_window(spark):
    draw = random.Random(1)
    rows = [
        {
            "id": str(i),
            "caller": draw.choice([None, "hot", "hot", "hot", *map(str, range(40))]),
            "call_date": draw.choice([None, *[f"2024-01-{d:02}" for d in range(1, 20)]]),
            "time_s": draw.choice([None, 1, 2, 3]),
        }
        for i in range(3000)
    ]
    calls = makers.calls(spark, rows)
    marked = mark_first_calls(calls)
    assert spark_bag(marked) == spark_bag(window_form(calls))
    per_caller = marked.groupBy("caller").agg(F.count_if("first_call").alias("n"))
    assert {row.n for row in per_caller.collect()} == {1}


def test_equal_rows_without_id(spark):
    calls = makers.calls(spark, [{"id": None}] * 3 + [{"id": None, "time_s": 99999}]).drop("id")
    marked = mark_first_calls(calls)
    assert sorted(row.first_call for row in marked.collect()) == [False, False, False, True]


def test_many_copies_are_unfolded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(groups, "COPIES_PER_TASK_ROW", 10)
    rows = spark.createDataFrame([("a",)] * 35 + [("b",)] * 10 + [(None,)], "x string")
    unfolded = groups.unfold_copies(groups.collapse_copies(rows))
    found = {row.x: row.n for row in unfolded.groupBy("x").agg(F.count("*").alias("n")).collect()}
    assert found == {"a": 35, "b": 10, None: 1}
    numbers = [row.copy_no for row in unfolded.filter("x = 'a'").collect()]
    assert sorted(numbers) == list(range(35))


def test_known_callers(spark):
    known = spark.createDataFrame([("1",), (None,)], "caller string")
    calls = makers.calls(spark, [{"caller": "1"}, {"caller": None}, {"caller": "2"}])
    assert makers.by_id(mark_first_calls(calls, known), "first_call") == {
        "1": False,
        "2": False,
        "3": True,
    }


def test_stored_flag_is_replaced(spark):
    calls = makers.calls(spark, [{"first_call": True, "call_date": dt.date(2024, 3, 5)}, {}])
    marked = mark_first_calls(calls)
    assert makers.by_id(marked, "first_call") == {"1": False, "2": True}


def test_group_stats_match_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    stats = groups.with_group_stats(rows, ["k"], F.count("*").alias("n"))
    assert sorted((row.v, row.n) for row in stats.collect()) == [(1, 2), (2, 2), (3, 1)]


@pytest.mark.parametrize(
    "ids",
    [[None, None], ["7", "7"], [None, "7"], ["7", None, "7"], ["", None], ["10", "9", "10", None]],
)
def test_one_first_call_whatever_the_ids(spark, ids):
    """Null, repeated and mixed ids, of calls at the same moment and of equal rows."""
    other = [{"id": "1", "caller": "x", "module": m} for m in ("a", None, "b")]
    calls = makers.calls(spark, [{"id": i} for i in ids] * 2 + other)
    marked = mark_first_calls(calls)
    assert spark_bag(marked.drop("first_call")) == spark_bag(calls.drop("first_call"))
    per_caller = marked.groupBy("caller").agg(F.count_if("first_call").alias("n")).collect()
    assert [row.n for row in per_caller] == [1, 1]
    chosen = marked.filter("first_call and caller <> 'x'").first().id
    assert chosen == min(ids, key=lambda i: (i is not None, len(i or ""), i or ""))
    assert marked.filter("first_call and caller = 'x'").first().module is None


def test_only_first_moments_are_sorted(spark):
    """Calls meet in a hash aggregate; what is sorted to be compared comes after a join with that."""
    rows = spark.range(5000).selectExpr(
        "cast(id as string) id", "date'2024-01-01' call_date", "cast(id as int) time_s",
        "cast(id % 700 as string) caller",
    )
    marked = mark_first_calls(rows)
    assert marked.filter("first_call").count() == 700
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("min(struct(")
    assert "LeftSemi" in plan[at:]
