"""Reports on random calls with nulls everywhere, against plain SQL."""

import datetime as dt
import random

import duckdb
import makers
import pytest
from compare import duck_bag, spark_bag
from pyspark.sql import functions as F

from ringlog.operators import attempts, clean, geo, origin, patterns, period, quality, series, states
from ringlog.operators.first_call import mark_first_calls
from ringlog.operators.refresh import refresh_calls
from ringlog.plans import oracle
from ringlog.schema import STATES, state_table
from ringlog.sources.files import read_annual
from ringlog.sources.table import write_calls

FLAGGED = """
    SELECT * EXCLUDE (first_call), row_number() OVER (PARTITION BY caller
      ORDER BY call_date NULLS LAST, time_s NULLS LAST, length(id), id) = 1 AS first_call
    FROM calls"""


def random_calls(spark, seed):
    draw = random.Random(seed)

    def maybe(value, chance=0.1):
        return None if draw.random() < chance else value

    names = [name for name, _ in STATES[:5]] + ["Atlantis"]
    rows = [
        {
            "id": str(i),
            "call_date": maybe(dt.date(2023, 12, 20) + dt.timedelta(draw.randrange(40)), 0.02),
            "time_s": maybe(draw.randrange(86400) if draw.random() < 0.7 else 7),
            "caller": maybe(draw.choice(["hot", "hot", *map(str, range(150))])),
            "duration_in": maybe(draw.choice([0, 0, 5, 70])),
            "duration_out": maybe(draw.choice([0, 30, 59, 60, 61, 500])),
            "success": maybe(draw.random() < 0.5),
            "state": maybe(draw.choice(names), 0.3),
            "is_landline": maybe(draw.random() < 0.6),
            "module": maybe(draw.choice("abc")),
        }
        for i in range(3000)
    ]
    return makers.calls(spark, rows)


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("random") / "calls")
    random_calls(spark, request.param).coalesce(1).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW calls AS SELECT * FROM '{path}/*.parquet'")
    connection.execute(f"CREATE VIEW flagged AS {FLAGGED}")
    connection.execute(f"CREATE VIEW states AS {oracle._CTES['states']}")
    connection.execute(f"CREATE VIEW originated AS {oracle._CTES['originated']}")
    calls = spark.read.parquet(path)
    return calls, mark_first_calls(calls), connection


def same(frame, connection, sql):
    assert spark_bag(frame) == duck_bag(connection, sql)


def test_first_calls(both):
    calls, marked, connection = both
    same(marked, connection, "SELECT * FROM flagged")


@pytest.mark.parametrize(
    ("unit", "keys"),
    [
        ("week", "isoyear(call_date)::INTEGER AS iso_year, week(call_date)::INTEGER AS iso_week"),
        ("month", "year(call_date)::INTEGER AS year, month(call_date)::INTEGER AS month"),
        ("year", "year(call_date)::INTEGER AS year"),
    ],
)
def test_periods(both, unit, keys):
    _, marked, connection = both
    groups = ", ".join(str(i + 1) for i in range(keys.count(" AS ")))
    same(
        period.period_report(marked, unit),
        connection,
        f"SELECT {keys}, {oracle._BOUNDS}, {oracle._MEASURES} FROM flagged GROUP BY {groups}",
    )


def test_days_in_a_period(both):
    _, marked, connection = both
    same(
        period.period_report(marked, "day", "2023-12-31", "2024-01-15"),
        connection,
        f"""SELECT call_date, strftime(call_date, '%a') AS weekday, {oracle._MEASURES}
            FROM flagged WHERE call_date BETWEEN '2023-12-31' AND '2024-01-15' GROUP BY call_date""",
    )


def test_series(both):
    calls, _, connection = both
    same(
        series.weekly_series(calls),
        connection,
        f"""SELECT {oracle._ISO}, count(*) AS n_calls, min(call_date) AS start_date,
                   max(call_date) AS end_date
            FROM calls WHERE success GROUP BY 1, 2
            HAVING min(call_date) + 6 = max(call_date)""",
    )


def test_origins(both, spark):
    _, marked, connection = both
    callers = "count(DISTINCT caller) + max((caller IS NULL)::INTEGER)"
    same(
        origin.origin_report(marked, state_table(spark)),
        connection,
        f"""SELECT iso_year, iso_week, origin, first_date, last_date, count(*) AS calls,
                   {callers} AS callers, count(*) FILTER (WHERE first_call) AS first_callers
            FROM originated GROUP BY ALL""",
    )
    pivoted = origin.pivot_origins(origin.origin_report(marked, state_table(spark)))
    same(
        pivoted.agg(F.sum("all_calls").alias("calls"), F.sum("na_calls").alias("unlabelled")),
        connection,
        """SELECT count(*) AS calls, count(*) FILTER (WHERE origin IS NULL) AS unlabelled
           FROM originated""",
    )


def test_map(both, spark):
    _, marked, connection = both
    same(
        states.state_map(marked, state_table(spark), "callers"),
        connection,
        """SELECT state, state_code, nullif(n, 0) AS n, coalesce(n, 0) AS label_n
           FROM states LEFT JOIN (
             SELECT state, count(DISTINCT caller) + max((caller IS NULL)::INTEGER) AS n
             FROM flagged WHERE is_landline GROUP BY state) c USING (state)""",
    )
    same(
        states.mobile_and_landline(marked, "calls"),
        connection,
        """SELECT count(*) FILTER (WHERE NOT is_landline) AS mobile,
                  count(*) FILTER (WHERE is_landline AND state IS NOT NULL) AS landline,
                  count(*) FILTER (WHERE is_landline IS NULL
                                   OR (is_landline AND state IS NULL)) AS unknown
           FROM flagged""",
    )


def test_patterns(both):
    calls, _, connection = both
    keys = f"""isodow(call_date)::INTEGER AS weekday_no, {oracle._WEEKDAY} AS weekday,
               (time_s // 3600)::INTEGER AS hour"""
    same(
        patterns.fail_share_table(calls),
        connection,
        f"""SELECT {keys}, count(*) FILTER (WHERE NOT success) / count(*) AS share
            FROM calls GROUP BY 1, 2, 3""",
    )
    same(
        patterns.heat_table(calls, 8, 21, only_failed=True),
        connection,
        f"""SELECT {keys}, count(*) AS n FROM calls
            WHERE time_s // 3600 BETWEEN 8 AND 21 AND NOT success GROUP BY 1, 2, 3""",
    )
    same(
        patterns.successful_by_hour(calls, strict=True),
        connection,
        """SELECT (time_s // 3600)::INTEGER AS hour, count(*) AS n FROM calls
           WHERE duration_in > 0 AND duration_out > 0 GROUP BY 1""",
    )


@pytest.mark.parametrize("strict", [False, True])
def test_attempts(both, strict):
    calls, _, connection = both
    success = "duration_in > 0 AND duration_out > 0" if strict else "success"
    days = f"""SELECT caller, call_date, count(*) AS attempts,
                      count(*) FILTER (WHERE {success}) AS successes
               FROM calls GROUP BY ALL"""
    same(
        attempts.attempt_histogram(calls, strict),
        connection,
        f"""SELECT least(attempts, 11) AS attempts_capped, successes > 0 AS any_success,
                   count(*) AS n FROM ({days}) d GROUP BY 1, 2""",
    )
    same(
        attempts.with_attempts(calls, strict).select("id", "attempts", "successes"),
        connection,
        f"""SELECT id, count(*) OVER w AS attempts,
                   count(*) FILTER (WHERE {success}) OVER w AS successes
            FROM calls WINDOW w AS (PARTITION BY caller, call_date)""",
    )
    found = attempts.attempt_quantiles(calls, strict=strict).first()
    wanted = connection.execute(
        f"SELECT quantile_cont(attempts, [0.5, 0.75, 0.9]) FROM ({days}) d"
    ).fetchall()[0][0]
    assert list(found) == pytest.approx(wanted)


def test_quality(both):
    calls, _, connection = both
    multiple = "SELECT *, count(*) OVER (PARTITION BY caller, call_date, time_s) AS n FROM calls"
    same(
        quality.with_multiplicity(calls).select("id", "n", "is_dup"),
        connection,
        f"SELECT id, n, n > 1 AS is_dup FROM ({multiple}) m",
    )
    for column in ("success", "module"):
        same(
            quality.duplicate_crosstab(calls, F.col(column), column),
            connection,
            f"""SELECT {column}, count(*) FILTER (WHERE n = 1) AS not_dup,
                       count(*) FILTER (WHERE n > 1) AS dup FROM ({multiple}) m GROUP BY 1""",
        )
    same(
        quality.duplicates_by_year(calls),
        connection,
        f"""SELECT year(call_date)::INTEGER AS year, n AS multiplicity, count(*) AS "rows"
            FROM ({multiple}) m GROUP BY 1, 2""",
    )
    same(
        quality.crosstab(calls, "module", "success", [False, True], "success_"),
        connection,
        """SELECT module, count(*) FILTER (WHERE NOT success) AS success_false,
                  count(*) FILTER (WHERE success) AS success_true FROM calls GROUP BY 1""",
    )
    same(
        quality.remove_duplicate_calls(calls).drop("first_call"),
        connection,
        "SELECT DISTINCT * EXCLUDE (id, module, first_call) FROM calls",
    )
    firsts = quality.remove_duplicate_calls(calls).groupBy("caller").agg(
        F.count_if("first_call").alias("n")
    )
    assert {row.n for row in firsts.collect()} == {1}


# Location


@pytest.fixture(scope="module", params=[3, 4])
def numbers_and_areas(request, spark, tmp_path_factory):
    """Numbers and codes of few digits, so that codes nest and repeat."""
    draw = random.Random(request.param)

    def digits(least, most):
        return "".join(draw.choice("2345") for _ in range(draw.randint(least, most)))

    codes = [
        ("0049" + digits(2, 5), draw.choice([None, "A", "B", "C"]), "Berlin", str(i))
        for i in range(60)
    ]
    calls = [
        (str(i), draw.choice([None, "0049" + digits(0, 9), "491" + digits(1, 5),
                              "0049" * 2 + digits(2, 5), "00491" + digits(3, 6)]))
        for i in range(1500)
    ]
    folder = tmp_path_factory.mktemp("area")
    areas = makers.areas(spark, codes)
    areas.coalesce(1).write.parquet(f"{folder}/areas")
    table = spark.createDataFrame(calls, "id string, caller string")
    table = clean.add_is_landline(table)
    table.coalesce(1).write.parquet(f"{folder}/calls")
    connection = duckdb.connect()
    for name in ("areas", "calls"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}/*.parquet'")
    return table, areas, connection


def test_prefix(numbers_and_areas):
    """A code whose rows differ in any attribute counts as several areas, as its names do."""
    table, areas, connection = numbers_and_areas
    found = geo.attach_area(table, areas, on_bad="flag")
    assert found.count() == table.count()
    same(
        found.select("id", "area_code", (F.col("area_matches") > 1).alias("several"),
                     (F.col("area_matches") == 0).alias("none")),
        connection,
        """WITH named AS (
               SELECT DISTINCT area_code, area_name, state, plz FROM areas WHERE area_name IS NOT NULL
           ), codes AS (
               SELECT area_code, count(*) AS kinds FROM named GROUP BY area_code
           )
           SELECT id, max_by(a.area_code, length(a.area_code)) AS area_code,
                  CASE WHEN is_landline
                       THEN count(DISTINCT area_name) > 1 OR max(coalesce(kinds, 0)) > 1 END AS several,
                  CASE WHEN is_landline THEN count(DISTINCT area_name) = 0 END AS "none"
           FROM calls LEFT JOIN (named a JOIN codes c ON c.area_code = a.area_code)
             ON is_landline AND starts_with(caller, a.area_code)
           GROUP BY id, is_landline""",
    )


def test_anywhere(numbers_and_areas):
    table, areas, connection = numbers_and_areas
    same(
        geo.attach_area_anywhere(table, areas).select("id", "area_code"),
        connection,
        """SELECT id, area_code FROM calls
           LEFT JOIN (SELECT DISTINCT area_code FROM areas) a ON contains(caller, area_code)""",
    )


# Files


def test_csv_roundtrip(both, spark, tmp_path):
    _, marked, _ = both
    write_calls(marked, str(tmp_path / "annual"), format="csv")
    again = read_annual(spark, str(tmp_path / "annual"))
    assert spark_bag(again) == spark_bag(marked.filter("call_date is not null"))


def test_refresh_continues_the_history(both):
    """Stored to some day and refreshed, the table is as if loaded at once."""
    _, marked, _ = both
    dated = marked.filter("call_date is not null")
    for day in ("2023-12-20", "2024-01-07", "2024-01-28"):
        stored = mark_first_calls(dated.filter(F.col("call_date") <= day)).cache()
        fetched = dated.drop("first_call").filter(F.col("call_date") >= day)
        whole = spark_bag(mark_first_calls(dated))
        assert spark_bag(refresh_calls(stored, fetched)) == whole
        assert spark_bag(refresh_calls(stored, fetched, recompute=True)) == whole
