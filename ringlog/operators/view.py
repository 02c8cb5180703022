"""What a reader of a table sees at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

PAGE_ROWS = 15


def page(
    table: DataFrame,
    number: int = 1,
    order_by: Sequence[str | Column] = (),
    where: Sequence[str | Column] = (),
    rows: int = PAGE_ROWS,
) -> DataFrame:
    """One page of a table, filtered by column conditions and sorted.

    Sort by columns that tell all rows apart, or pages may overlap.
    """
    for condition in where:
        table = table.filter(condition)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    return table.orderBy(*order).offset((number - 1) * rows).limit(rows)


@dataclass(frozen=True)
class Place:
    """Where a page ended: its last row, and how many rows equal to it have been shown."""

    row: Row
    copies: int


def _order(table: DataFrame, order_by: Mapping[str, bool]) -> dict[str, bool]:
    """Columns to sort by and whether descending: those asked for, then all others."""
    return dict(order_by) | {c: False for c in table.columns if c not in order_by}


def _beyond(name: str, value: object, descending: bool) -> Column:
    """Whether a column comes after a value: nulls first upwards, last downwards."""
    column = F.col(name)
    if value is None:
        return F.lit(False) if descending else column.isNotNull()
    if descending:
        return (column < F.lit(value)) | column.isNull()
    return F.coalesce(column > F.lit(value), F.lit(False))


def page_after(
    table: DataFrame,
    order_by: Mapping[str, bool],
    after: Place | None = None,
    where: Sequence[str | Column] = (),
    rows: int = PAGE_ROWS,
) -> DataFrame:
    """The page that follows a place, or the first: rows in the order of some columns.

    order_by has the columns and whether descending; ties are broken by all other
    columns, so pages do not overlap, leave nothing out, and stay in step if rows are
    added before them. Rows before the place are filtered and not sorted, and only the
    page's rows leave a task. Equal rows are all shown.
    """
    for condition in where:
        table = table.filter(condition)
    order = _order(table, order_by)
    sorting = [F.desc(c) if descending else F.asc(c) for c, descending in order.items()]
    if after is None:
        return table.orderBy(*sorting).limit(rows)
    same = F.lit(True)
    later = F.lit(False)
    for name, descending in order.items():
        later = later | (same & _beyond(name, after.row[name], descending))
        same = same & F.col(name).eqNullSafe(F.lit(after.row[name]))
    rest = table.filter(later | same)
    return rest.orderBy(*sorting).offset(after.copies).limit(rows)


def place_after(shown: Sequence[Row], before: Place | None = None) -> Place | None:
    """The place at the end of a page that was shown after another; none at the table's end."""
    if not shown:
        return None
    copies = reduce(lambda n, row: n + 1 if row == shown[-1] else 0, shown, 0)
    if before is not None and copies == len(shown) and before.row == shown[-1]:
        copies += before.copies
    return Place(shown[-1], copies)
