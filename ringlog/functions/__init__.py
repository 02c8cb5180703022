from ringlog.functions.calendar import (
    clock_text,
    display_date,
    hour_of,
    in_period,
    iso_week,
    iso_year,
    parse_clock,
    parse_date,
    weekday_label,
    weekday_no,
)
from ringlog.functions.measures import (
    capped,
    count_callers,
    display_count,
    fail_share,
    null_to_zero,
    percent_label,
    strict_success,
    zero_to_null,
)
from ringlog.functions.phone import is_landline, map_label, origin_label, pseudonym

__all__ = [
    "capped",
    "clock_text",
    "count_callers",
    "display_count",
    "display_date",
    "fail_share",
    "hour_of",
    "in_period",
    "is_landline",
    "iso_week",
    "iso_year",
    "map_label",
    "null_to_zero",
    "origin_label",
    "parse_clock",
    "parse_date",
    "percent_label",
    "pseudonym",
    "strict_success",
    "weekday_label",
    "weekday_no",
    "zero_to_null",
]
