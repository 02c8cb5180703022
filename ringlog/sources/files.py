"""Reading the exchanged CSV files."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlog.operators.clean import parse_records
from ringlog.schema import AREA_FIELDS, LEGACY_FIELDS, text_or_null
from ringlog.session import read_head

# Quotes inside a cell are doubled.
CSV = {"header": "true", "quote": '"', "escape": '"'}


def _as_text(headings: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(heading, T.StringType()) for heading in headings])


FOLDER = {"pathGlobFilter": "*.csv", "recursiveFileLookup": "true"}


#: Bytes of a file in which its header is looked for first.
HEAD_BYTES = 1 << 16
#: Files whose beginnings are read at the same time.
READERS = 16


def first_record(data: bytes, whole: bool) -> list[str] | None:
    """The first record with a value, as names; none if the data may end within it."""
    text = data.decode("utf-8-sig", "ignore")
    lines = io.StringIO(text, newline="")
    for row in csv.reader(lines):
        if any(cell.strip() for cell in row):
            return [cell.strip() for cell in row] if whole or lines.tell() < len(text) else None
    return [] if whole else None


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    size = HEAD_BYTES
    while True:
        data = read_head(spark, file, size)
        found = first_record(data, len(data) < size)
        if found is not None:
            return tuple(found)
        size *= 4


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The CSV files below a folder by their header, of which only the beginning is read."""
    found = spark.read.format("binaryFile").options(**FOLDER).load(path)
    files = sorted(row.path for row in found.select("path").collect())
    with ThreadPoolExecutor(READERS) as pool:
        names = list(pool.map(lambda file: _header(spark, file), files))
    kinds: dict[tuple[str, ...], list[str]] = {}
    for file, own in zip(files, names, strict=True):
        if own:
            kinds.setdefault(own, []).append(file)
    return dict(sorted(kinds.items()))


def _records(spark: SparkSession, names: Sequence[str], files: list[str], multi_line: bool) -> DataFrame:
    """The records of files with one header, without lines that repeat it or are blank."""
    cells = [f"c{k}" for k in range(len(names))]
    options = CSV | {"header": "false", "multiLine": str(multi_line).lower()}
    rows = spark.read.options(**options).schema(_as_text(cells)).csv(files)
    first = F.regexp_replace("c0", "^\\ufeff", "")
    same = [F.trim(first if k == 0 else F.col(c)) for k, c in enumerate(cells)]
    header = reduce(
        Column.__and__,
        [F.coalesce(cell, F.lit("")) == F.lit(name) for cell, name in zip(same, names, strict=True)],
    )
    others = F.coalesce(*cells[1:]).isNull() if len(cells) > 1 else F.lit(True)
    blank = F.coalesce(F.trim("c0") == "", F.lit(False)) & others
    place = {name: names.index(name) for name in names}
    return rows.filter(~header & ~blank).select(
        *[F.col(cells[k]).alias(name) for name, k in place.items()]
    )


def read_text_by_name(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV files in a folder as text columns, matched by name; missing ones are null.

    A CSV read with one schema matches columns by position. So files are put together
    by their header, of which only the first bytes are read, and each kind is read by
    Spark's CSV reader: every file once. A cell in quotes may hold line breaks; a file
    is then read by one task, and multi_line=False lets large files without such cells
    be cut. Lines that repeat their file's header are left out.
    """
    kinds = headers(spark, path)
    if not kinds:
        raise FileNotFoundError(f"no CSV files with a header in {path}")
    parts = [_records(spark, names, files, multi_line) for names, files in kinds.items()]
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts)


def read_annual(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All annual files, typed by name; text that is no value becomes null."""
    if not path:
        raise ValueError("no folder given for the annual call files")
    return parse_records(read_text_by_name(spark, path, multi_line))


def read_legacy(
    spark: SparkSession,
    file: str,
    fields: Sequence[str] = LEGACY_FIELDS,
    multi_line: bool = True,
) -> DataFrame:
    """The former single file, whose columns are known by position only.

    As in annual files, a cell may hold line breaks unless multi_line is off.
    """
    options = CSV | {"multiLine": str(multi_line).lower()}
    raw = spark.read.options(**options).schema(_as_text(fields)).csv(file)
    return parse_records(raw.withColumnRenamed("landline", "is_landline"))


def _read_text(spark: SparkSession, file: str) -> DataFrame:
    raw = spark.read.options(**CSV, multiLine="true").csv(file)
    return raw.select(*[text_or_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_areas(spark: SparkSession, file: str) -> DataFrame:
    """S3: area codes; all text, as codes have leading zeros."""
    raw = _read_text(spark, file)
    return raw.select(*[F.col(old).alias(new) for old, new in AREA_FIELDS.items()])


def read_states(spark: SparkSession, file: str) -> DataFrame:
    """States with their short codes and where to put their labels."""
    raw = _read_text(spark, file)
    return raw.select(
        F.col("Bundesland").alias("state"),
        F.col("bl_short").alias("state_code"),
        F.col("lat_correct").try_cast("double").alias("lat_correct"),
        F.col("lon_correct").try_cast("double").alias("lon_correct"),
    )


def read_state_attributes(spark: SparkSession, file: str) -> DataFrame:
    """Attributes of the states, as text."""
    return _read_text(spark, file)
