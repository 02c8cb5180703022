"""Small call tables made by hand."""

import datetime as dt

from ringlog.schema import CALLS

DEFAULTS = {
    "id": None,
    "call_date": dt.date(2024, 3, 4),
    "time_s": 36000,
    "caller": "004930123456",
    "duration_in": 100,
    "duration_out": 90,
    "success": True,
    "area_code": None,
    "area_name": None,
    "state": None,
    "plz": None,
    "first_call": False,
    "is_landline": True,
    "module": None,
}


def calls(spark, rows):
    """Calls with the given values; ids count up where none is given."""
    full = []
    for number, row in enumerate(rows, 1):
        values = DEFAULTS | {"id": str(number)} | row
        if isinstance(values["call_date"], str):
            values["call_date"] = dt.date.fromisoformat(values["call_date"])
        full.append(tuple(values[name] for name in CALLS.names))
    return spark.createDataFrame(full, CALLS)


def areas(spark, rows):
    return spark.createDataFrame(
        [(code, name, state, plz) for code, name, state, plz in rows],
        "area_code string, area_name string, state string, plz string",
    )


def records(spark, rows):
    """API records as text."""
    defaults = {
        "id": "1",
        "date": "2024-03-04",
        "time": "10:00:00",
        "service": "0800",
        "service_caption": "Hotline",
        "caller": "004930123456",
        "tarif": "T1",
        "modul_name": "Hotline",
        "duration_inbound": "100",
        "duration_outbound": "90",
        "success": "true",
    }
    schema = ", ".join(f"{name} string" for name in defaults)
    return spark.createDataFrame([tuple((defaults | row).values()) for row in rows], schema)


def by_id(frame, *columns):
    return {
        row.id: tuple(row[c] for c in columns) if len(columns) > 1 else row[columns[0]]
        for row in frame.collect()
    }
