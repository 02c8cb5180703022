"""The same queries in SQL, written from their definitions.

Where the library avoids a window, a theta join or a row-level pass, the SQL
takes the plain form, so the two agree only if the rewrite is right.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the library shows.
WEEKDAYS = ["Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag"]
STATES = [
    ("Baden-Württemberg", "BW"), ("Bayern", "BY"), ("Berlin", "BE"), ("Brandenburg", "BB"),
    ("Bremen", "HB"), ("Hamburg", "HH"), ("Hessen", "HE"), ("Mecklenburg-Vorpommern", "MV"),
    ("Niedersachsen", "NI"), ("Nordrhein-Westfalen", "NW"), ("Rheinland-Pfalz", "RP"),
    ("Saarland", "SL"), ("Sachsen", "SN"), ("Sachsen-Anhalt", "ST"), ("Schleswig-Holstein", "SH"),
    ("Thüringen", "TH"),
]
MOBILE, UNLABELLED = "Mobil", "NA"
ORIGINS = [MOBILE, *sorted(code for _, code in STATES), "Unbk."]
MEASURES = ("calls", "callers", "first_callers")
_COLUMN = {"Mobil": "mobil", "Unbk.": "unbk", "NA": "na"} | {c: c.lower() for _, c in STATES}

_STATE_LIST = ", ".join(f"'{name}'" for name, _ in STATES)
_STATE_ROWS = ", ".join(f"('{name}', '{code}')" for name, code in STATES)
_WEEKDAY = "[" + ", ".join(f"'{d}'" for d in WEEKDAYS) + "][isodow(call_date)]"

# Tables shared by the queries.
_CTES = {
    "states": f"SELECT * FROM (VALUES {_STATE_ROWS}) t(state, state_code)",
    "areas": f"""
        SELECT n_nationkey,
               CASE n_nationkey % 4
                 WHEN 0 THEN '00493' || n_nationkey
                 WHEN 1 THEN '00492' || lpad(n_nationkey::VARCHAR, 2, '0')
                 WHEN 2 THEN '00496' || lpad(n_nationkey::VARCHAR, 3, '0')
                 ELSE '00499' || lpad(n_nationkey::VARCHAR, 4, '0') END AS area_code,
               n_name AS area_name,
               CASE WHEN n_nationkey < 24 THEN [{_STATE_LIST}][n_nationkey % 16 + 1] END AS state,
               lpad((n_nationkey * 397)::VARCHAR, 5, '0') || ', '
                 || lpad((n_nationkey * 397 + 1)::VARCHAR, 5, '0') AS plz
        FROM nation""",
    "numbers": """
        SELECT c_custkey,
               CASE WHEN c_custkey % 20 < 9
                    THEN '004915' || lpad(c_custkey::VARCHAR, greatest(8, length(c_custkey::VARCHAR))::INTEGER, '0')
                    ELSE area_code || lpad(c_custkey::VARCHAR, greatest(7, length(c_custkey::VARCHAR))::INTEGER, '0') END AS caller,
               c_custkey % 20 >= 9 AS is_landline,
               CASE WHEN c_custkey % 20 >= 9 THEN area_code END AS area_code,
               CASE WHEN c_custkey % 20 >= 9 THEN area_name END AS area_name,
               CASE WHEN c_custkey % 20 >= 9 THEN state END AS state,
               CASE WHEN c_custkey % 20 >= 9 THEN plz END AS plz
        FROM customer JOIN areas ON c_nationkey = n_nationkey""",
    "calls": """
        SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE AS call_date,
               ((o_orderkey * 7919) % 86400)::INTEGER AS time_s, caller,
               (o_orderkey % 1500)::INTEGER AS duration_in,
               (floor(o_totalprice)::BIGINT % 2000)::INTEGER AS duration_out,
               o_orderstatus <> 'P' AS success,
               area_code, area_name, state, plz, is_landline, NULL::VARCHAR AS module
        FROM orders JOIN numbers ON o_custkey = c_custkey""",
    "flagged": """
        SELECT *, row_number() OVER (PARTITION BY caller
                    ORDER BY call_date NULLS LAST, time_s NULLS LAST, length(id), id) = 1 AS first_call
        FROM calls""",
    "raw": """
        SELECT id, strftime(call_date, '%Y-%m-%d') AS "date",
               lpad((time_s // 3600)::VARCHAR, 2, '0') || ':'
                 || lpad((time_s % 3600 // 60)::VARCHAR, 2, '0') || ':'
                 || lpad((time_s % 60)::VARCHAR, 2, '0') AS "time",
               '0800' AS service, 'Hotline' AS service_caption, caller, 'T1' AS tarif,
               'Hotline' AS modul_name, duration_in::VARCHAR AS duration_inbound,
               duration_out::VARCHAR AS duration_outbound, success::VARCHAR AS success
        FROM calls""",
    "rerouted": """
        SELECT id, call_date, time_s, caller,
               CASE WHEN duration_out < 40 THEN 0 ELSE duration_in END AS duration_in,
               CASE WHEN duration_out < 40 THEN 0 ELSE duration_out END AS duration_out,
               success AND duration_out >= 40 AS success,
               area_code, area_name, state, plz, is_landline, 'Hotline' AS module
        FROM calls
        UNION ALL
        SELECT 'r' || id, call_date, time_s, caller, 0, 0, FALSE,
               area_code, area_name, state, plz, is_landline, 'Routingpunkt Easy'
        FROM calls WHERE duration_out < 40""",
    "event_calls": """
        SELECT event_id::VARCHAR AS id, ts::DATE AS call_date,
               (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INTEGER AS time_s,
               user_id::VARCHAR AS caller, (event_id % 3)::INTEGER AS duration_in,
               floor("value")::INTEGER AS duration_out, event_type <> 'error' AS success
        FROM events""",
    "numbered": r"""
        SELECT id, caller, NOT regexp_matches(caller, '^00491|^491|^0049800|^49800') AS is_landline
        FROM calls""",
    "numbered_oddly": r"""
        SELECT id, caller, NOT regexp_matches(caller, '^00491|^491|^0049800|^49800') AS is_landline
        FROM (SELECT id, CASE WHEN id::BIGINT % 17 = 0 AND NOT starts_with(caller, '00491')
                              THEN '0049777' || substr(caller, 8) ELSE caller END AS caller
              FROM calls)""",
    "caller_days": """
        SELECT caller, call_date, count(*) AS attempts,
               count(*) FILTER (WHERE success) AS successes
        FROM event_calls GROUP BY ALL""",
    "strict_days": """
        SELECT caller, call_date, count(*) AS attempts,
               count(*) FILTER (WHERE duration_in > 0 AND duration_out > 0) AS successes
        FROM event_calls GROUP BY ALL""",
    "multiple": """
        SELECT *, count(*) OVER (PARTITION BY caller, call_date, time_s) AS n FROM rerouted""",
    "by_label": """
        SELECT CASE WHEN NOT is_landline THEN 'mobil' ELSE state END AS label, * FROM flagged""",
    "originated": """
        SELECT f.*, isoyear(call_date)::INTEGER AS iso_year, week(call_date)::INTEGER AS iso_week,
               CASE WHEN state_code IS NULL AND is_landline THEN 'Unbk.'
                    WHEN NOT is_landline THEN 'Mobil' ELSE state_code END AS origin,
               min(call_date) OVER (PARTITION BY isoyear(call_date), week(call_date)) AS first_date,
               max(call_date) OVER (PARTITION BY isoyear(call_date), week(call_date)) AS last_date
        FROM flagged f LEFT JOIN states USING (state)""",
    "origins": """
        SELECT iso_year, iso_week, origin, first_date, last_date, count(*) AS calls,
               count(DISTINCT caller) AS callers,
               count(*) FILTER (WHERE first_call) AS first_callers
        FROM originated GROUP BY ALL""",
    "daily": "SELECT call_date, count(*) AS n, year(call_date)::INTEGER AS year FROM calls GROUP BY ALL",
    "boxes": """
        SELECT year, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median,
               quantile_cont(n, 0.75) AS q3
        FROM daily GROUP BY year""",
    "fenced": """
        SELECT daily.*, q1, median, q3,
               n BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
        FROM daily JOIN boxes USING (year)""",
}

_NEEDS = {
    "numbers": ["areas"],
    "calls": ["numbers"],
    "flagged": ["calls"],
    "raw": ["calls"],
    "rerouted": ["calls"],
    "numbered": ["calls"],
    "numbered_oddly": ["calls"],
    "caller_days": ["event_calls"],
    "strict_days": ["event_calls"],
    "multiple": ["rerouted"],
    "by_label": ["flagged"],
    "originated": ["flagged", "states"],
    "origins": ["originated"],
    "daily": ["calls"],
    "boxes": ["daily"],
    "fenced": ["daily", "boxes"],
}


def _with(select: str, *tables: str) -> str:
    """Put the shared tables a query needs before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for table in tables:
        need(table)
    shared = ", ".join(f"{name} AS ({_CTES[name]})" for name in order)
    return f"WITH {shared} {select}" if shared else select


_MEASURES = """
    count(caller) AS calls,
    count(*) FILTER (WHERE success) AS calls_ok,
    count(*) FILTER (WHERE duration_out < 60 AND success) AS calls_lt_1min,
    round(avg(duration_out) FILTER (WHERE success) / 60, 1) AS mean_minutes,
    round(max(duration_out) FILTER (WHERE success) / 60, 1) AS max_minutes,
    count(DISTINCT caller) + max((caller IS NULL)::INTEGER) AS callers,
    round(count(caller) / (count(DISTINCT caller) + max((caller IS NULL)::INTEGER)), 1) AS calls_per_caller,
    count(*) FILTER (WHERE first_call) AS first_callers"""
_BOUNDS = "min(call_date) AS first_date, max(call_date) AS last_date"
_ISO = "isoyear(call_date)::INTEGER AS iso_year, week(call_date)::INTEGER AS iso_week"


# One call of each caller, whatever the ids: all columns in their order decide.
_FIRST_OF_ALL = """row_number() OVER (PARTITION BY caller
    ORDER BY call_date, time_s, length(id) NULLS FIRST, id NULLS FIRST, duration_in, duration_out,
             success, area_code NULLS FIRST, area_name NULLS FIRST, state NULLS FIRST,
             plz NULLS FIRST, is_landline, module) = 1"""


def _series(source: str, where: str) -> str:
    return _with(
        f"""SELECT {_ISO}, count(*) AS n_calls, min(call_date) AS start_date,
                   max(call_date) AS end_date
            FROM {source} WHERE {where}
            GROUP BY isoyear(call_date), week(call_date)
            HAVING min(call_date) + 6 = max(call_date)""",
        source,
    )


_MATCHES = """
    SELECT caller, count(DISTINCT area_name) AS matches
    FROM (SELECT DISTINCT caller FROM numbered_oddly WHERE is_landline) n
    LEFT JOIN areas ON starts_with(caller, area_code)
    GROUP BY caller"""


def _map(measure: str, where: str = "TRUE") -> str:
    return _with(
        f"""SELECT state, state_code, nullif(n, 0) AS n, coalesce(n, 0) AS label_n
            FROM states LEFT JOIN
                 (SELECT label, {measure} AS n FROM by_label WHERE {where} GROUP BY label) c
                 ON label = states.state""",
        "states",
        "by_label",
    )


def _heat(where: str, value: str = "count(*) AS n") -> str:
    return _with(
        f"""SELECT isodow(call_date)::INTEGER AS weekday_no, {_WEEKDAY} AS weekday,
                   (time_s // 3600)::INTEGER AS hour, {value}
            FROM calls WHERE {where} GROUP BY 1, 2, 3""",
        "calls",
    )


def _dup_crosstab(value: str, name: str) -> str:
    return _with(
        f"""SELECT {value} AS {name}, count(*) FILTER (WHERE n = 1) AS not_dup,
                   count(*) FILTER (WHERE n > 1) AS dup
            FROM multiple GROUP BY 1""",
        "multiple",
    )


def _pivot(shown: bool = False) -> str:
    """One column per origin and measure, by column name or by heading."""
    head = {"calls": "Anrufe", "callers": "Anrufer*innen", "first_callers": "Erstanrufer*innen"}
    keys = ["iso_year", "iso_week", "first_date", "last_date"]
    names = ["Jahr", "Kalenderwoche", "Start", "Ende"] if shown else keys
    ordered = [MOBILE, *sorted({*ORIGINS, UNLABELLED} - {MOBILE})]
    cells = ", ".join(
        f"""coalesce(sum({m}) FILTER (WHERE coalesce(origin, 'NA') = '{o}'), 0)::BIGINT
            AS "{f"{o} {head[m]}" if shown else f"{_COLUMN[o]}_{m}"}\""""
        for o in ordered
        for m in MEASURES
    )
    totals = ", ".join(
        f'sum({m})::BIGINT AS "{f"Alle {head[m]}" if shown else f"all_{m}"}"' for m in MEASURES
    )
    year, week, first, last = names
    return _with(
        f"""SELECT origins.iso_year::VARCHAR AS "{year}", origins.iso_week AS "{week}",
                   origins.first_date AS "{first}", origins.last_date AS "{last}", {totals}, {cells}
            FROM origins
            GROUP BY origins.iso_year, origins.iso_week, origins.first_date, origins.last_date""",
        "origins",
    )


# Chunks by running sums over all days.
_CHUNKS = """
    , days AS (
        SELECT d::DATE AS call_date, coalesce(n, 0) AS n
        FROM (SELECT unnest(generate_series(min(call_date)::TIMESTAMP, max(call_date)::TIMESTAMP,
                                            INTERVAL 1 DAY)) AS d FROM daily) s
        LEFT JOIN daily ON daily.call_date = d::DATE),
    running AS (
        SELECT *, sum(n) OVER (ORDER BY call_date) - n AS before,
               sum((n > 300)::INTEGER) OVER (ORDER BY call_date) AS heavy_so_far,
               sum(n) OVER () AS total
        FROM days),
    pieces AS (
        SELECT *, CASE WHEN total <= 1000 THEN 'all'
                       ELSE heavy_so_far || '/' || (n > 300) || '/' || floor(before / 700) END AS piece
        FROM running)
"""


def _synthetic() -> str:
    def draw(i: int) -> str:
        return f"('0x' || substr(digest, {1 + 7 * i}, 7))::BIGINT"

    return _with(
        f"""SELECT o_orderkey::VARCHAR AS id,
                   DATE '2020-01-01' + ({draw(0)} % 2047)::INTEGER AS call_date,
                   ({draw(1)} % 86400)::INTEGER AS time_s,
                   ({draw(2)} % 30000)::VARCHAR AS caller,
                   ({draw(3)} % 2000)::INTEGER AS duration_in,
                   ({draw(4)} % 2000)::INTEGER AS duration_out,
                   {draw(5)} % 100 < 61 AS success,
                   {draw(6)} % 100 < 55 AS is_landline,
                   {draw(7)} % 100 < 61 AS first_call,
                   area_code, area_name, state, plz
            FROM (SELECT o_orderkey, sha256('5432:' || o_orderkey) AS digest FROM orders) d
            JOIN (SELECT *, row_number() OVER (ORDER BY area_code) - 1 AS area_no FROM areas) a
              ON area_no = {draw(8)} % 25""",
        "areas",
    )


def oracle_sql() -> dict[str, str]:
    return {
        "period_week": _with(
            f"SELECT {_ISO}, {_BOUNDS}, {_MEASURES} FROM flagged GROUP BY 1, 2", "flagged"
        ),
        "period_month": _with(
            f"""SELECT year(call_date)::INTEGER AS year, month(call_date)::INTEGER AS month,
                       {_BOUNDS}, {_MEASURES} FROM flagged GROUP BY 1, 2""",
            "flagged",
        ),
        "period_year": _with(
            f"""SELECT year(call_date)::INTEGER AS year, {_BOUNDS}, {_MEASURES}
                FROM flagged GROUP BY 1""",
            "flagged",
        ),
        "period_day": _with(
            f"""SELECT call_date, strftime(call_date, '%a') AS weekday, {_MEASURES}
                FROM flagged GROUP BY call_date ORDER BY call_date DESC""",
            "flagged",
        ),
        "shown_week": _with(
            f"""SELECT iso_year AS "Jahr", iso_week AS "Kalenderwoche", first_date AS "Start",
                       last_date AS "Ende", calls AS "Anrufe", calls_ok AS "Anrufe (erfolgreich)",
                       calls_lt_1min AS "Telefonate < 1min",
                       mean_minutes AS "Mittlere Telefonatdauer (min)",
                       max_minutes AS "Längstes Telefonat (min)",
                       callers AS "Versch. Anrufer*innen",
                       calls_per_caller AS "Mittlere Anrufe pro Anrufer*in",
                       first_callers AS "Erstanrufer*innen"
                FROM (SELECT {_ISO}, {_BOUNDS}, {_MEASURES} FROM flagged GROUP BY 1, 2) report""",
            "flagged",
        ),
        "shown_origin": _pivot(shown=True),
        "data_bounds": _with(
            "SELECT min(call_date) AS oldest, max(call_date) AS newest FROM calls", "calls"
        ),
        "clamped_period": _with(
            """SELECT greatest(DATE '1990-01-01', min(call_date)) AS start,
                      max(call_date) AS stop FROM calls""",
            "calls",
        ),
        "weekly_series": _series("calls", "success"),
        "weekly_series_state": _series("calls", "state = 'Berlin'"),
        "weekly_series_first": _series("flagged", "first_call"),
        "first_call": _with("SELECT id, caller, first_call FROM flagged", "flagged"),
        "parsed_records": _with(
            """SELECT id, call_date, time_s, '0800' AS service, 'Hotline' AS service_caption,
                      caller, 'T1' AS tarif, 'Hotline' AS module, duration_in, duration_out, success
               FROM calls""",
            "calls",
        ),
        "landline_flag": _with("SELECT id, caller, is_landline FROM numbered", "numbered"),
        "hash_caller": _with("SELECT id, sha256(caller) AS caller FROM calls", "calls"),
        "clean_calls": _with(
            """SELECT calls.id, call_date, time_s, sha256(calls.caller) AS caller, duration_in,
                      duration_out, success, numbered.is_landline, 'Hotline' AS module,
                      areas.area_code, areas.area_name, areas.state, areas.plz
               FROM calls JOIN numbered USING (id)
               LEFT JOIN areas ON numbered.is_landline
                              AND starts_with(calls.caller, areas.area_code)""",
            "calls",
            "numbered",
        ),
        "area_prefix_join": _with(
            """SELECT id, caller, is_landline, area_code, area_name, state, plz
               FROM numbered LEFT JOIN areas ON is_landline AND starts_with(caller, area_code)""",
            "numbered",
        ),
        "area_quarantine": _with(
            """SELECT id, caller, is_landline, NULL::VARCHAR AS area_code,
                      NULL::VARCHAR AS area_name, NULL::VARCHAR AS state, NULL::VARCHAR AS plz,
                      0::BIGINT AS area_matches
               FROM numbered_oddly
               WHERE is_landline AND NOT EXISTS (
                 SELECT 1 FROM areas WHERE starts_with(caller, area_code))""",
            "numbered_oddly",
        ),
        "area_contains_join": _with(
            """SELECT id, caller, is_landline, area_code, area_name, state, plz
               FROM numbered LEFT JOIN areas ON contains(caller, area_code)""",
            "numbered",
        ),
        "prefix_match_check": _with(_MATCHES, "numbered_oddly"),
        "prefix_match_distribution": _with(
            f"SELECT matches, count(*) AS numbers FROM ({_MATCHES}) m GROUP BY matches",
            "numbered_oddly",
        ),
        "prefix_candidates": _with(
            """SELECT caller, k::INTEGER AS prefix_length, substr(caller, 1, k) AS area_code
               FROM (SELECT DISTINCT caller FROM numbered WHERE is_landline) n,
                    (VALUES (6), (7), (8), (9)) lengths(k)""",
            "numbered",
        ),
        "area_code_lengths": _with(
            """SELECT (length(area_code) - 3)::INTEGER AS code_length, count(*) AS n
               FROM numbered JOIN areas ON is_landline AND starts_with(caller, area_code)
               GROUP BY 1""",
            "numbered",
        ),
        "repaired_umlauts": _with(
            "SELECT id, replace(area_name || 'ue ', 'ue', 'ü') AS state FROM calls", "calls"
        ),
        "legacy_column": _with(
            """SELECT id, CASE WHEN is_landline THEN 'TRUE' WHEN id::BIGINT % 3 > 0 THEN 'FALSE'
                               ELSE 'NA' END AS landline,
                      CASE WHEN is_landline THEN TRUE WHEN id::BIGINT % 3 > 0 THEN FALSE
                           END AS is_landline
               FROM calls""",
            "calls",
        ),
        "first_call_without_ids": _with(
            f"""SELECT caller, call_date, time_s, module, {_FIRST_OF_ALL} AS first_call
                FROM (SELECT NULL::VARCHAR AS id, * EXCLUDE (id) FROM rerouted) d""",
            "rerouted",
        ),
        "first_call_mixed_ids": _with(
            f"""SELECT id, caller, call_date, time_s, module, {_FIRST_OF_ALL} AS first_call
                FROM (SELECT CASE WHEN ltrim(id, 'r')::BIGINT % 3 > 0 THEN ltrim(id, 'r') END AS id,
                             * EXCLUDE (id) FROM rerouted) d""",
            "rerouted",
        ),
        "period_week_range": _with(
            f"""SELECT {_ISO}, {_BOUNDS}, {_MEASURES} FROM flagged
                WHERE call_date BETWEEN DATE '1996-03-05' AND DATE '1998-10-20' GROUP BY 1, 2""",
            "flagged",
        ),
        "origin_range": _with(
            """SELECT iso_year, iso_week, origin,
                      min(min(call_date)) OVER (PARTITION BY iso_year, iso_week) AS first_date,
                      max(max(call_date)) OVER (PARTITION BY iso_year, iso_week) AS last_date,
                      count(*) AS calls, count(DISTINCT caller) AS callers,
                      count(*) FILTER (WHERE first_call) AS first_callers
               FROM originated WHERE call_date BETWEEN DATE '1996-03-05' AND DATE '1998-10-20'
               GROUP BY iso_year, iso_week, origin""",
            "originated",
        ),
        "record_count_range": _with(
            """SELECT count(*) AS n FROM calls
               WHERE call_date BETWEEN DATE '1996-03-05' AND DATE '1998-10-20'""",
            "calls",
        ),
        "period_year_with_gaps": _with(
            f"""SELECT year(call_date)::INTEGER AS year, {_BOUNDS}, {_MEASURES}
                FROM (SELECT *, row_number() OVER (PARTITION BY caller
                                  ORDER BY call_date, time_s, length(id), id) = 1 AS first_call
                      FROM (SELECT * REPLACE (CASE WHEN id::BIGINT % 11 > 0 THEN caller END AS caller,
                                              CASE WHEN id::BIGINT % 13 > 0 THEN success END AS success)
                            FROM calls)) f
                GROUP BY 1""",
            "calls",
        ),
        "landline_kinds": _with(
            r"""SELECT id, caller,
                       NOT regexp_matches(caller, '^00491|^491|^0049800|^49800') AS is_landline
                FROM (SELECT id, CASE id::BIGINT % 5 WHEN 0 THEN '0049800' || id
                                   WHEN 1 THEN substr(caller, 3) ELSE caller END AS caller
                      FROM calls)""",
            "calls",
        ),
        "dedup_strict": _with(
            """SELECT DISTINCT * EXCLUDE (id, module)
               FROM (SELECT *, row_number() OVER (PARTITION BY caller
                                 ORDER BY call_date, time_s, length(id), id) = 1 AS first_call
                     FROM rerouted)""",
            "rerouted",
        ),
        "refreshed_table": _with(
            """SELECT id, call_date, time_s, sha256(caller) AS caller, state, first_call
               FROM flagged""",
            "flagged",
        ),
        "table_by_day": _with(
            """SELECT id, call_date, time_s, caller, duration_in, duration_out, success,
                      NULL::VARCHAR AS area_code, NULL::VARCHAR AS area_name,
                      NULL::VARCHAR AS state, NULL::VARCHAR AS plz,
                      row_number() OVER (PARTITION BY caller
                        ORDER BY call_date, time_s, length(id), id) = 1 AS first_call,
                      NULL::BOOLEAN AS is_landline, NULL::VARCHAR AS module,
                      year(call_date)::INTEGER AS year, call_date AS day
               FROM event_calls""",
            "event_calls",
        ),
        "origin_long": _with("SELECT * FROM origins", "origins"),
        "origin_pivot": _pivot(),
        "origin_totals": _with(
            """SELECT origin, grouping(origin) = 1 AS is_total, count(*) AS calls,
                      count(DISTINCT caller) AS callers,
                      count(*) FILTER (WHERE first_call) AS first_callers
               FROM originated GROUP BY ROLLUP (origin)""",
            "originated",
        ),
        "week_bounds": _with(
            """SELECT id, iso_year, iso_week, first_date AS week_first, last_date AS week_last
               FROM originated""",
            "originated",
        ),
        "state_map_calls": _map("count(*)"),
        "state_map_callers": _map("count(DISTINCT caller)"),
        "state_map_first": _map("count(*) FILTER (WHERE first_call)", "success"),
        "mobile_landline_totals": _with(
            """SELECT count(DISTINCT caller) FILTER (WHERE label = 'mobil') AS mobile,
                      (SELECT sum(n)::BIGINT FROM (
                         SELECT count(DISTINCT caller) AS n FROM by_label
                         WHERE label <> 'mobil' GROUP BY label) s) AS landline,
                      count(DISTINCT caller) FILTER (WHERE label IS NULL) AS unknown
               FROM by_label""",
            "by_label",
        ),
        "state_attributes": _with(
            """SELECT state, id AS "OBJECTID", state_code
               FROM calls JOIN states USING (state)""",
            "calls",
            "states",
        ),
        "hour_success": _with(
            """SELECT (time_s // 3600)::INTEGER AS hour, count(*) AS n
               FROM calls WHERE success GROUP BY 1""",
            "calls",
        ),
        "hour_success_strict": _with(
            """SELECT (time_s // 3600)::INTEGER AS hour, count(*) AS n
               FROM event_calls WHERE duration_in > 0 AND duration_out > 0 GROUP BY 1""",
            "event_calls",
        ),
        "hour_of_call": "SELECT event_id::VARCHAR AS id, hour(ts)::INTEGER AS hour FROM events",
        "weekday_calls": _with(
            f"""SELECT isodow(call_date)::INTEGER AS weekday_no, {_WEEKDAY} AS weekday,
                       count(*) AS n FROM calls GROUP BY 1, 2""",
            "calls",
        ),
        "weekday_success": _with(
            f"""SELECT isodow(call_date)::INTEGER AS weekday_no, {_WEEKDAY} AS weekday, success,
                       count(*) AS n FROM calls GROUP BY 1, 2, 3""",
            "calls",
        ),
        "weekday_fail_share": _with(
            f"""SELECT isodow(call_date)::INTEGER AS weekday_no, {_WEEKDAY} AS weekday,
                       count(*) FILTER (WHERE NOT success) / count(*) AS share,
                       printf('%.2f', round(100 * (count(*) FILTER (WHERE NOT success) / count(*)), 2))
                         || '%' AS share_label
                FROM calls GROUP BY 1, 2""",
            "calls",
        ),
        "heat_all": _heat("TRUE"),
        "heat_daytime": _heat("time_s // 3600 BETWEEN 8 AND 21"),
        "heat_fail": _heat("time_s // 3600 BETWEEN 8 AND 21 AND NOT success"),
        "heat_fail_share": _heat(
            "TRUE", "count(*) FILTER (WHERE NOT success) / count(*) AS share"
        ),
        "attempts_per_day": _with(
            """SELECT id, caller, call_date, count(*) OVER w AS attempts,
                      count(*) FILTER (WHERE success) OVER w AS successes
               FROM event_calls WINDOW w AS (PARTITION BY caller, call_date)""",
            "event_calls",
        ),
        "caller_days": _with(
            "SELECT *, successes > 0 AS any_success FROM caller_days", "caller_days"
        ),
        "attempt_hist": _with(
            """SELECT CASE WHEN attempts > 10 THEN 11 ELSE attempts END AS attempts_capped,
                      successes > 0 AS any_success, count(*) AS n
               FROM caller_days GROUP BY 1, 2""",
            "caller_days",
        ),
        "attempt_hist_strict": _with(
            """SELECT CASE WHEN attempts > 10 THEN 11 ELSE attempts END AS attempts_capped,
                      successes > 0 AS any_success, count(*) AS n
               FROM strict_days GROUP BY 1, 2""",
            "strict_days",
        ),
        "attempt_hist_fail": _with(
            """SELECT CASE WHEN attempts > 10 THEN 11 ELSE attempts END AS attempts_capped,
                      FALSE AS any_success, count(*) AS n
               FROM strict_days WHERE successes = 0 GROUP BY 1""",
            "strict_days",
        ),
        "attempt_quantiles": _with(
            """SELECT quantile_cont(attempts, 0.5) AS p50, quantile_cont(attempts, 0.75) AS p75,
                      quantile_cont(attempts, 0.9) AS p90 FROM caller_days""",
            "caller_days",
        ),
        "dup_multiplicity": _with("SELECT id, n, n > 1 AS is_dup FROM multiple", "multiple"),
        "dup_by_year": _with(
            """SELECT year(call_date)::INTEGER AS year, n AS multiplicity, count(*) AS "rows"
               FROM multiple GROUP BY 1, 2""",
            "multiple",
        ),
        "dup_pairs": _with(
            """SELECT count(*) FILTER (WHERE n = 2) / 2 AS pairs,
                      count(*) FILTER (WHERE n > 1) / 2 AS repeated_halved FROM multiple""",
            "multiple",
        ),
        "dup_groups": _with(
            """SELECT caller, call_date, time_s, count(*) AS n FROM rerouted
               GROUP BY 1, 2, 3 HAVING count(*) > 1 ORDER BY n DESC, call_date DESC""",
            "rerouted",
        ),
        "dup_compare": _with(
            """SELECT n, coalesce(a, 0) AS groups_left, coalesce(b, 0) AS groups_right
               FROM (SELECT n, count(*) AS a FROM
                      (SELECT count(*) AS n FROM rerouted GROUP BY caller, call_date, time_s) x
                     WHERE n > 1 GROUP BY n) l
               FULL JOIN
                    (SELECT n, count(*) AS b FROM
                      (SELECT count(*) AS n FROM calls GROUP BY caller, call_date, time_s) y
                     WHERE n > 1 GROUP BY n) r USING (n)""",
            "rerouted",
        ),
        "dup_crosstab_success": _dup_crosstab("success", "success"),
        "dup_crosstab_module": _dup_crosstab("module", "module"),
        "dup_crosstab_zero": _dup_crosstab("duration_in = 0", "no_duration"),
        "module_success": _with(
            """SELECT module, count(*) FILTER (WHERE NOT success) AS success_false,
                      count(*) FILTER (WHERE success) AS success_true
               FROM rerouted GROUP BY module""",
            "rerouted",
        ),
        "dedup_calls": _with(
            """SELECT *, row_number() OVER (PARTITION BY caller ORDER BY call_date, time_s) = 1 AS first_call
               FROM (SELECT DISTINCT * EXCLUDE (id, module) FROM rerouted) d""",
            "rerouted",
        ),
        "distinct_check": _with(
            """SELECT (SELECT count(*) FROM rerouted) AS "rows", count(*) AS distinct_rows,
                      (SELECT count(*) FROM rerouted) = count(*) AS ok
               FROM (SELECT DISTINCT * EXCLUDE (id, module) FROM rerouted) d""",
            "rerouted",
        ),
        "missing_days": _with(
            """SELECT d::DATE AS call_date
               FROM (SELECT unnest(generate_series(min(call_date)::TIMESTAMP,
                       max(call_date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM calls) s
               WHERE d::DATE NOT IN (SELECT call_date FROM calls)""",
            "calls",
        ),
        "calls_per_day": _with("SELECT call_date, n FROM daily ORDER BY n, call_date", "daily"),
        "daily_box_stats": _with(
            """SELECT year, q1, median, q3, min(n) FILTER (WHERE inside) AS low_whisker,
                      max(n) FILTER (WHERE inside) AS high_whisker,
                      count(*) FILTER (WHERE NOT inside) AS outliers
               FROM fenced GROUP BY year, q1, median, q3""",
            "fenced",
        ),
        "daily_outliers": _with("SELECT year, call_date, n FROM fenced WHERE NOT inside", "fenced"),
        "six_number_summary": _with(
            """SELECT min(n)::DOUBLE AS minimum, quantile_cont(n, 0.25) AS q1,
                      quantile_cont(n, 0.5) AS median, avg(n) AS mean,
                      quantile_cont(n, 0.75) AS q3, max(n)::DOUBLE AS maximum
               FROM (SELECT count(*) AS n FROM rerouted GROUP BY caller, call_date, time_s) g""",
            "rerouted",
        ),
        "api_records": _with("SELECT * FROM raw", "raw"),
        "api_projection": _with("SELECT * FROM raw", "raw"),
        "redundant_columns": _with(
            "SELECT * EXCLUDE (service, service_caption, tarif) FROM raw", "raw"
        ),
        "record_count": _with("SELECT count(*) AS n FROM calls", "calls"),
        "chunk_plan": _with("", "daily")
        + _CHUNKS
        + """SELECT row_number() OVER (ORDER BY min(call_date))::INTEGER AS chunk,
                    min(call_date) AS start, max(call_date) AS stop, sum(n)::BIGINT AS n,
                    sum(n) > 1000 AND count(*) = 1 AS oversize
             FROM pieces GROUP BY piece""",
        "union_by_name": _with(
            """SELECT id, call_date, time_s, caller, success, state, is_landline FROM calls
               UNION ALL
               SELECT id, call_date, time_s, caller, success, NULL, NULL FROM event_calls""",
            "calls",
            "event_calls",
        ),
        "annual_roundtrip": _with("SELECT * FROM flagged", "flagged"),
        "annual_line_breaks": _with(
            """SELECT * REPLACE ('"' || area_name || '"' || chr(10) || plz AS area_name)
               FROM flagged""",
            "flagged",
        ),
        "legacy_file": _with("SELECT * EXCLUDE (id, module) FROM flagged", "flagged"),
        "legacy_split": _with(
            f"""SELECT call_date, time_s, caller, area_code, {_FIRST_OF_ALL} AS first_call,
                       year(call_date)::INTEGER AS year, call_date AS day
                FROM (SELECT * REPLACE (NULL::VARCHAR AS id) FROM calls)""",
            "calls",
        ),
        "area_file": _with("SELECT area_code, area_name, state, plz FROM areas", "areas"),
        "state_file": _with(
            """SELECT state, state_code, min(area_code::BIGINT % 90) / 2 AS lat_correct,
                      -max(area_code::BIGINT % 90) / 4 AS lon_correct
               FROM areas JOIN states USING (state) GROUP BY ALL""",
            "areas",
            "states",
        ),
        "area_some_columns": _with(
            """SELECT id, caller, is_landline, area_code, state
               FROM numbered LEFT JOIN areas ON is_landline AND starts_with(caller, area_code)""",
            "numbered",
        ),
        "area_several": _with(
            """, wide AS (
                   SELECT area_code, area_name, state, plz FROM areas
                   UNION ALL
                   SELECT area_code, 'Neu ' || area_name, state, plz FROM areas WHERE n_nationkey % 5 = 0
                   UNION ALL
                   SELECT area_code[:6], area_name, state, plz FROM areas WHERE n_nationkey % 4 = 2
               ), kinds AS (
                   SELECT area_code, count(DISTINCT (area_name, state, plz)) AS n,
                          arg_min(area_name, area_name) AS area_name
                   FROM wide GROUP BY area_code
               )
               SELECT id, substr(caller, 1, 9) AS dialled,
                      CASE WHEN is_landline
                           THEN count(DISTINCT k.area_name) + count(*) FILTER (k.n > 1) END
                          AS area_matches
               FROM numbered_oddly LEFT JOIN kinds k
                 ON is_landline AND starts_with(caller, k.area_code)
               GROUP BY id, caller, is_landline""",
            "numbered_oddly",
        ),
        "attempts_beyond_the_cap": _with(
            """SELECT least(attempts, 11) AS attempts_capped, ok > 0 AS any_success, count(*) AS n
               FROM (SELECT right(caller, 1) AS caller, call_date, count(*) AS attempts,
                            count(*) FILTER (WHERE success) AS ok
                     FROM event_calls GROUP BY 1, 2)
               GROUP BY ALL""",
            "event_calls",
        ),
        "some_years_written": _with(
            """SELECT id, caller, year(call_date)::INTEGER AS year, call_date AS day FROM calls
               WHERE is_landline OR year(call_date) NOT IN (1994, 1996)""",
            "calls",
        ),
        "rows_out_of_order": _with("SELECT count(*) AS n, 0::BIGINT AS late FROM calls", "calls"),
        "export_content": _with(
            f"""SELECT COLUMNS(*)::VARCHAR FROM (
                    SELECT {_ISO}, {_BOUNDS}, {_MEASURES}, 'a "b", c' AS note
                    FROM flagged GROUP BY 1, 2)""",
            "flagged",
        ),
        "replacement_pending": _with("SELECT * FROM flagged", "flagged"),
        "replacement_finished": _with("SELECT * FROM flagged", "flagged"),
        "caller_index": _with(
            """SELECT sha256(number) AS caller, min(call_date) AS first_day
               FROM (SELECT call_date,
                            CASE WHEN time_s < (SELECT quantile_cont(time_s, 0.5) FROM event_calls)
                                 THEN caller ELSE '004915' || caller END AS number
                     FROM event_calls)
               GROUP BY number""",
            "event_calls",
        ),
        "months_of_days": _with(
            f"""SELECT * EXCLUDE (calls_per_caller) REPLACE (TRUE AS callers) FROM (
                    SELECT year(call_date)::INTEGER AS year, month(call_date)::INTEGER AS month,
                           {_BOUNDS}, {_MEASURES}
                    FROM flagged GROUP BY 1, 2)""",
            "flagged",
        ),
        "weeks_of_days": _with(
            f"""SELECT * EXCLUDE (callers, calls_per_caller) FROM (
                    SELECT {_ISO}, {_BOUNDS}, {_MEASURES} FROM flagged
                    WHERE call_date BETWEEN '1994-02-03' AND '1996-11-12' GROUP BY 1, 2)""",
            "flagged",
        ),
        "box_stats_of_days": _with(
            """SELECT year, q1, median, q3, min(n) FILTER (WHERE inside) AS low_whisker,
                      max(n) FILTER (WHERE inside) AS high_whisker,
                      count(*) FILTER (WHERE NOT inside) AS outliers
               FROM fenced GROUP BY year, q1, median, q3""",
            "fenced",
        ),
        "attempt_quantiles_of_days": _with(
            """SELECT DISTINCT year(call_date)::INTEGER AS year,
                      TRUE AS p50, TRUE AS p75, TRUE AS p90
               FROM event_calls""",
            "event_calls",
        ),
        "talk_time_of_days": _with(
            """SELECT year(call_date)::INTEGER AS year, month(call_date)::INTEGER AS month,
                      min(duration_out)::DOUBLE AS minimum, avg(duration_out) AS mean,
                      max(duration_out)::DOUBLE AS maximum, TRUE AS ordered
               FROM calls WHERE success GROUP BY 1, 2""",
            "calls",
        ),
        "responses_by_index": _with(
            "SELECT * FROM raw WHERE date BETWEEN '1995-02-03' AND '1996-01-20'", "raw"
        ),
        "page_after_row": _with(
            """SELECT call_date, count(caller) AS calls, count(DISTINCT caller) AS callers
               FROM flagged GROUP BY call_date
               ORDER BY calls DESC, call_date DESC LIMIT 15 OFFSET 15""",
            "flagged",
        ),
        "refresh_replace_day": _with("SELECT * FROM flagged", "flagged"),
        "export_names": _with(
            """SELECT 'wochentabelle_' || min(call_date) || '_' || max(call_date) AS name
               FROM calls""",
            "calls",
        ),
        "display_formats": _with(
            """SELECT call_date, strftime(call_date, '%d.%m.%Y') AS day_label,
                      replace(format('{:,}', 1000 * n), ',', '.') AS count_label FROM daily""",
            "daily",
        ),
        "table_view_page": _with(
            f"""SELECT call_date, strftime(call_date, '%a') AS weekday, {_MEASURES}
                FROM flagged GROUP BY call_date HAVING count(caller) >= 1
                ORDER BY calls DESC, call_date DESC LIMIT 15 OFFSET 15""",
            "flagged",
        ),
        "synth_calls": _synthetic(),
    }
