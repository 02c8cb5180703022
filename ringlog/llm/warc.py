"""WARC archives as a Spark data source (operator 5).

`spark.dataSource.register(WarcSource)` makes the format "warc" known.

Reading, one row per record: warc_type, record_id, target_uri, refers_to,
payload_digest, payload_length, content_length, headers, payload. Files are
planned into partitions on the driver by name and size alone. Predicates on the
first seven columns are pushed down to the tasks: these parse a record's headers
first, and where they fail a predicate the block is stepped over, neither read nor
decoded. `read_records` takes the predicates with the read. With the option
pushdown=true, for which spark.sql.python.filterPushdown.enabled has to be on, those
of a `where` on the frame are pushed down too; then read a frame of its own for each
`where`, as Spark 4.1 keeps what was pushed with the frame that was read, and every
other use of that frame sees it.
With the option payload=false no block is read at all. Option partition_bytes is
the size up to which small files share a task (64 MB).

Writing, from rows with warc_type, record_id, target_uri, refers_to,
payload_digest, payload_length and payload: every task writes files of its own and
begins a new one at file_bytes (64 MB). A commit writes the list of the files of
the tasks that counted; readers go by that list, so what a lost or repeated task
left behind is never read. Option date is the records' WARC-Date.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .scratch import new_path, written

SCHEMA = (
    "warc_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_length bigint, content_length bigint, "
    "headers map<string,string>, payload binary"
)
ARROW = pa.schema(
    [
        ("warc_type", pa.string()),
        ("record_id", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_length", pa.int64()),
        ("content_length", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)
#: Fixed values of the format: the header that each column stands for.
HEADER_OF = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "content_length": "Content-Length",
}
NUMBERS = ("payload_length", "content_length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How the names of the lists of committed files begin.
MANIFEST = "_files"
MEGABYTE = 1 << 20


# Reading


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _listed(store: fs.FileSystem, root: str, path: str) -> list[tuple[str, int]]:
    """The files that a job has committed, and their sizes."""
    with store.open_input_stream(path) as stream:
        lines = stream.read().decode().splitlines()
    return [(f"{root}/{name}", int(size)) for size, name in (x.split(" ", 1) for x in lines)]


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class _Blocks:
    """A file read front to back in large pieces, in which stretches can be stepped over."""

    def __init__(self, stream, seekable: bool):
        self.stream, self.seekable = stream, seekable
        self.held, self.at = b"", 0

    def _more(self, size: int) -> bool:
        new = self.stream.read(max(size, MEGABYTE))
        self.held, self.at = self.held[self.at :] + new, 0
        return bool(new)

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end of the file."""
        while True:
            while self.held[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            end = self.held.find(b"\r\n\r\n", self.at)
            if end >= 0:
                found, self.at = self.held[self.at : end], end + 4
                return found
            if not self._more(MEGABYTE):
                if self.held[self.at :].strip():
                    raise ValueError("a WARC file ends within a record's headers")
                return None

    def block(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self._more(size - (len(self.held) - self.at)):
                raise ValueError("a WARC file ends within a record's block")
        found, self.at = self.held[self.at : self.at + size], self.at + size
        return found

    def step_over(self, size: int) -> None:
        rest = size - (len(self.held) - self.at)
        if rest <= 0:
            self.at += size
        elif self.seekable:
            self.held, self.at = b"", 0
            self.stream.seek(self.stream.tell() + rest)
        else:
            self.block(size)


def parse_headers(head: bytes) -> dict[str, str]:
    """The headers of a record; a line that begins with white space goes on from the last."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += f" {line.strip()}"
        else:
            name, _, value = line.partition(":")
            name = name.strip()
            found[name] = value.strip()
    return found


def columns_of(headers: dict[str, str]) -> dict[str, str | int | None]:
    """The columns that stand for headers, whose names are matched in any case."""
    lower = {name.lower(): value for name, value in headers.items()}
    found = {column: lower.get(name.lower()) for column, name in HEADER_OF.items()}
    return found | {c: int(found[c]) if found[c] is not None else None for c in NUMBERS}


def holds(rule: Filter, row: dict) -> bool:
    """Whether the columns of a record's headers pass a predicate."""
    value = row[rule.attribute[0]]
    if isinstance(rule, IsNull):
        return value is None
    if isinstance(rule, EqualNullSafe):
        return value == rule.value
    if value is None:
        return False
    if isinstance(rule, IsNotNull):
        return True
    tests = {
        EqualTo: lambda: value == rule.value,
        In: lambda: value in rule.value,
        GreaterThan: lambda: value > rule.value,
        GreaterThanOrEqual: lambda: value >= rule.value,
        LessThan: lambda: value < rule.value,
        LessThanOrEqual: lambda: value <= rule.value,
        StringStartsWith: lambda: value.startswith(rule.value),
        StringEndsWith: lambda: value.endswith(rule.value),
        StringContains: lambda: rule.value in value,
    }
    return tests[type(rule)]()


PUSHED = (
    EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)


#: The predicates of `read_records`, by the word that names them.
RULES = {
    "=": EqualTo, "in": In, "<": LessThan, "<=": LessThanOrEqual, ">": GreaterThan,
    ">=": GreaterThanOrEqual, "startswith": StringStartsWith, "endswith": StringEndsWith,
    "contains": StringContains, "is null": IsNull, "is not null": IsNotNull,
}


def rule(column: str, test: str, *value) -> Filter:
    if column not in HEADER_OF or test not in RULES:
        raise ValueError(f"no predicate: {column} {test}")
    return RULES[test]((column,), *(tuple(x) if isinstance(x, list) else x for x in value))


def payload_of(block: bytes, content_type: str) -> bytes:
    """The body of an HTTP message, or the whole block of any other kind."""
    if content_type.startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 64 * MEGABYTE))
        self.rules = [rule(*each) for each in json.loads(options.get("where", "[]"))]

    def partitions(self):
        """Files in order of their names, small ones together up to partition_bytes."""
        store, root = _opened(self.path)
        there = store.get_file_info(root)
        if there.type == fs.FileType.File:
            files = [(root, there.size)]
        else:
            found = store.get_file_info(fs.FileSelector(root))
            # Where jobs have written, what their lists name; else all archives there are.
            lists = sorted(x.path for x in found if x.base_name.startswith(MANIFEST))
            files = sorted(
                (x.path, x.size) for x in found if x.path.endswith((".warc", ".warc.gz"))
            )
            if lists:
                files = [each for path in lists for each in _listed(store, root, path)]
        plans: list[Files] = []
        held: list[str] = []
        size = 0
        for path, length in files:
            if held and size + length > self.partition_bytes:
                plans.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += length
        return [*plans, Files(tuple(held))]

    def read(self, partition):
        store = _opened(self.path)[0]
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            packed = path.endswith(".gz")
            opened = (
                store.open_input_stream(path, compression="gzip")
                if packed
                else store.open_input_file(path)
            )
            with opened as stream:
                for row in self._records(_Blocks(stream, not packed)):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 * MEGABYTE:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _records(self, blocks: _Blocks) -> Iterator[dict]:
        while (head := blocks.head()) is not None:
            headers = parse_headers(head)
            row = columns_of(headers)
            length = row["content_length"] or 0
            if not all(holds(rule, row) for rule in self.rules):
                blocks.step_over(length)
                continue
            payload = None
            if self.with_payload and row["warc_type"] != "revisit":
                payload = payload_of(blocks.block(length), headers.get("Content-Type", ""))
            else:
                blocks.step_over(length)
            digest = row["payload_digest"]
            row["payload_digest"] = digest.removeprefix("sha1:") if digest else None
            yield row | {"headers": list(headers.items()), "payload": payload}


class PushingReader(WarcReader):
    """Takes predicates of a `where` on the frame as well."""

    def pushFilters(self, filters):
        for rule in filters:
            if isinstance(rule, PUSHED) and rule.attribute[0] in HEADER_OF:
                self.rules.append(rule)
            else:
                yield rule


# Writing


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[int, str], ...]


def record(row: dict, date: str) -> bytes:
    """One record with its headers; a revisit has the HTTP headers as its block, no payload."""
    payload = row["payload"] or b""
    length = len(payload) if row["payload_length"] is None else row["payload_length"]
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {length}\r\n\r\n"
    ).encode()
    block = http if row["warc_type"] == "revisit" else http + payload
    given = [
        ("WARC-Type", row["warc_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", REVISIT_PROFILE if row["warc_type"] == "revisit" else None),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}" if row["payload_digest"] else None),
        ("X-Payload-Length", str(length)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(
        f"{name}: {' '.join(str(value).split())}\r\n" for name, value in given if value is not None
    )
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.file_bytes = int(options.get("file_bytes", 64 * MEGABYTE))

    def write(self, iterator):
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        files: list[tuple[int, str]] = []
        stream, name, size = None, "", 0
        for batch in iterator:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if stream is None:
                        name, size = f"part-{uuid.uuid4().hex}.warc", 0
                        stream = store.open_output_stream(f"{root}/{name}")
                    data = record(row, self.date)
                    stream.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        stream.close()
                        files.append((size, name))
                        stream = None
        if stream is not None:
            stream.close()
            files.append((size, name))
        return Written(tuple(files))

    def commit(self, messages):
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        files = sorted(file for message in messages if message for file in message.files)
        # A list of its own, so that several jobs may write into one folder.
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}") as stream:
            stream.write("".join(f"{size} {name}\n" for size, name in files).encode())

    def abort(self, messages):
        store, root = _opened(self.path)
        for message in messages:
            for _, name in message.files if message else ():
                store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushes else WarcReader)(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format "warc" known."""
    spark.dataSource.register(WarcSource)


# Pages to records and back


def base32(digest: Column) -> Column:
    """The upper-case base 32 of a SHA-1 digest in hexadecimal: 32 characters, no padding."""
    parts = [
        F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)
    ]
    # conv counts with 0 to 9 and A to V, base 32 with A to Z and 2 to 7.
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _page_id(record_id: Column, kind: str) -> Column:
    found = F.regexp_extract(record_id, "^<urn:x-page:(.*)>$", 1)
    return F.when(found != "none", found).cast(kind)


def records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
) -> DataFrame:
    """The rows that the writer takes, one per page; the payload is the html in UTF-8.

    A null html is an empty payload. Of the pages with equal payloads of at least
    `min_bytes` bytes, that with the largest id is the response and the others
    revisit it; smaller payloads are all responses. A null id counts as the
    smallest; rows that repeat the largest id are all responses, and so is a group
    without ids.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("target_uri"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha1", "best")
    )
    # Written first: its measured size tells whether the pages have to move for the join.
    groups = written(groups, "warc-groups")
    revisits = F.coalesce(F.col("best") > F.coalesce("id", F.col("best") - 1), F.lit(False))
    return rows.join(groups, "sha1", "left").select(
        F.when(revisits, "revisit").otherwise("response").alias("warc_type"),
        _record_id(F.col("id")).alias("record_id"),
        "target_uri",
        F.when(revisits, _record_id(F.col("best"))).alias("refers_to"),
        base32(F.col("sha1")).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_length"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, **columns) -> None:
    """Write a WARC record per page into a folder."""
    register(pages.sparkSession)
    found = records(pages, **columns)
    found.write.format("warc").mode("append").option("path", path).save()


def read_records(
    spark: SparkSession, path: str, where: list[tuple] | None = None, **options: str
) -> DataFrame:
    """The records of the archives in a folder, or of one file.

    where: predicates that all have to hold, such as ("warc_type", "in", ["revisit"]),
    ("payload_length", ">", 0) or ("refers_to", "is null"); see RULES.
    """
    register(spark)
    reader = spark.read.format("warc").options(**options)
    return reader.option("where", json.dumps(where or [])).load(path)


def page_records(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages read back.

    Length and digest of a response are those of the payload as it was read, and
    must be those of its headers; a revisit has them in its headers alone.
    """
    # Columns of their own: within the branches of a `when`, Spark computes an expression
    # anew at each place that names it, and base32 names the digest several times.
    found = found.withColumns(
        {"read_sha1": F.sha1("payload"), "read_bytes": F.octet_length("payload").cast("bigint")}
    ).withColumn("read_digest", base32(F.col("read_sha1")))
    size, digest = F.col("read_bytes"), F.col("read_digest")
    checked = F.when(
        (digest == F.col("payload_digest")) & (size == F.col("payload_length")), digest
    ).otherwise(F.raise_error(F.concat(F.lit("damaged payload of "), "record_id")))
    response = F.col("warc_type") == "response"
    return found.select(
        _page_id(F.col("record_id"), id_type).alias("page_id"),
        F.when(response, size).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, checked).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        _page_id(F.col("refers_to"), id_type).alias("refers_to"),
    )


def through_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, and read these back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_pages(pages, path, min_bytes=min_bytes)
    return page_records(read_records(spark, path, [("warc_type", "in", ["response", "revisit"])]))
