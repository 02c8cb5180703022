"""Operator 5: archives written and read back."""

import base64
import gzip
import hashlib

import pytest

from ringlog.llm import queries, warc

COLUMNS = "page_id bigint, url string, html string, sha1 int, best string, payload string"


def plain(pages, least=0):
    """(page_id, bytes, digest, type, refers_to), from payloads in plain Python."""
    best = {}
    for page, html in pages:
        if page is not None:
            best[html or ""] = max(best.get(html or "", page), page)
    rows = []
    for page, html in pages:
        data = (html or "").encode()
        top = best.get(html or "")
        revisit = len(data) >= least and top is not None and (page is None or page < top)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rows.append((page, len(data), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(rows, key=str)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op5_warc(spark, sf_dir).collect()), key=str) == plain(pages)


@pytest.mark.parametrize("least", [0, 1, 8])
def test_odd_pages(spark, tmp_path, least):
    rows = [
        (1, "http://a", "same"), (2, "http://b", "same"), (7, None, "same"), (7, "http://c", "same"),
        (3, "http://d", ""), (4, "http://e", None), (5, "x\r\nWARC-Type: revisit", "é😀" * 40_000),
        (None, "http://f", "same"), (None, None, None), (6, "http://g", "WARC/1.1\r\nWARC-Type: resource\r\n\r\n"),
        (8, "http://h", "a longer page"), (9, "http://h", "a longer page"),
    ]
    frame = spark.createDataFrame([(*r, 1, "b", "p") for r in rows], COLUMNS).repartition(3)
    found = warc.through_archives(frame, f"{tmp_path}/archive", min_bytes=least).collect()
    assert sorted(map(tuple, found), key=str) == plain([(r[0], r[2]) for r in rows], least)


def test_no_pages(spark, tmp_path):
    frame = spark.createDataFrame([], COLUMNS)
    assert warc.through_archives(frame, f"{tmp_path}/archive").count() == 0


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archive")
    rows = [(k, f"http://host{k % 3}/{k}", f"<p>{k % 40}</p>" * (k % 4 + 1)) for k in range(200)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    warc.write_pages(frame, path)
    return path


RULES = [
    ([("warc_type", "=", "revisit")], "warc_type = 'revisit'"),
    ([("warc_type", "in", ["response", "x"])], "warc_type in ('response', 'x')"),
    ([("payload_length", ">", 18)], "payload_length > 18"),
    ([("payload_length", "<=", 18), ("warc_type", "=", "response")], "payload_length <= 18 and warc_type = 'response'"),
    ([("target_uri", "startswith", "http://host1/")], "target_uri like 'http://host1/%'"),
    ([("target_uri", "endswith", "9")], "target_uri like '%9'"),
    ([("target_uri", "contains", "t2")], "target_uri like '%t2%'"),
    ([("refers_to", "is null")], "refers_to is null"),
    ([("refers_to", "is not null")], "refers_to is not null"),
    ([("payload_length", ">=", 16), ("payload_length", "<", 30)], "payload_length >= 16 and payload_length < 30"),
]


def bag(frame):
    return sorted(str(r) for r in frame.collect())


def test_predicates(spark, archive):
    everything = warc.read_records(spark, archive).cache()
    assert everything.count() == 200
    for rules, text in RULES:
        want = bag(everything.where(text))
        assert bag(warc.read_records(spark, archive, rules)) == want != [], text
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for _, text in RULES:
            assert bag(warc.read_records(spark, archive, pushdown="true").where(text)) == bag(everything.where(text))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(ValueError, match="no predicate"):
        warc.rule("headers", "=", "x")


def test_blocks_are_stepped_over(archive, monkeypatch):
    """With predicates, or without payloads, only wanted blocks are read."""
    from pyspark.sql.datasource import EqualTo

    read = []
    block = warc._Blocks.block
    monkeypatch.setattr(warc._Blocks, "block", lambda self, size: read.append(size) or block(self, size))
    reader = warc.PushingReader({"path": archive})
    assert list(reader.pushFilters([EqualTo(("record_id",), "<urn:x-page:199>"), EqualTo(("headers",), 1)])) == [
        EqualTo(("headers",), 1)
    ]
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert len(rows) == 1 and len(read) == 1
    read.clear()
    reader = warc.WarcReader({"path": archive, "payload": "false"})
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert len(rows) == 200 and not read and all(r["payload"] is None for r in rows)


def test_partitions_go_by_size(archive):
    assert len(warc.WarcReader({"path": archive}).partitions()) == 1
    assert len(warc.WarcReader({"path": archive, "partition_bytes": "1"}).partitions()) >= 4


def test_foreign_archives(spark, tmp_path):
    """Headers in any case and over two lines, other kinds of records, gzip members."""
    one = (
        b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 5\r\nX-Note: a\r\n b\r\n\r\nhello\r\n\r\n"
        b"WARC/1.0\r\nWARC-TYPE: resource\r\ncontent-length: 0\r\n\r\n\r\n\r\n"
    )
    two = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted(r.warc_type for r in rows) == ["metadata", "resource", "resource", "warcinfo", "warcinfo"]
    assert {bytes(r.payload) for r in rows} == {b"hello", b"", b"abc"}
    assert next(r for r in rows if r.warc_type == "warcinfo").headers["X-Note"] == "a b"
    (tmp_path / "c.warc").write_bytes(one[:-20])
    with pytest.raises(Exception, match="ends within"):
        warc.read_records(spark, str(tmp_path / "c.warc")).collect()


def test_writes_into_one_folder_add_up(spark, tmp_path):
    """Two jobs' archives are read whole; a file that no job has committed is not."""
    path = str(tmp_path / "archive")
    for ids in ((1, 2), (3,)):
        rows = [(k, f"http://h/{k}", f"<p>{k}</p>") for k in ids]
        warc.write_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    (tmp_path / "archive" / "part-lost.warc").write_bytes(b"WARC/1.1")
    rows = warc.read_records(spark, path).collect()
    assert sorted(bytes(row.payload) for row in rows) == [b"<p>1</p>", b"<p>2</p>", b"<p>3</p>"]


def test_payloads_are_hashed_once(spark, archive):
    """The code for reading back has one SHA-1 a record, not one for each digit of its digest."""
    plan = warc.page_records(warc.read_records(spark, archive))._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    assert code.count("DigestUtils.sha1Hex(") == 1


def test_base32(spark):
    digests = ["0" * 40, "f" * 40, "0123456789" * 4, "00000000010000000000fffffffff0000000000a"]
    digests += [hashlib.sha1(str(k).encode()).hexdigest() for k in range(200)]
    rows = spark.createDataFrame([(d,) for d in [*digests, None]], "digest string")
    found = {r.digest: r.found for r in rows.select("digest", warc.base32(rows.digest).alias("found")).collect()}
    assert found == {None: None} | {d: base64.b32encode(bytes.fromhex(d)).decode() for d in digests}


@pytest.mark.parametrize("old, new", [(b"<p>7</p>", b"<p>8</p>"), (b"X-Payload-Length: 8", b"X-Payload-Length: 9")])
def test_damaged_payloads(spark, tmp_path, old, new):
    """A payload that differs from the digest or length of its headers ends the reading."""
    path = str(tmp_path / "archive")
    page = [(7, "http://h/7", "<p>7</p>")]
    warc.write_pages(spark.createDataFrame(page, "page_id bigint, url string, html string"), path)
    (file,) = (tmp_path / "archive").glob("*.warc")
    file.write_bytes(file.read_bytes().replace(old, new))
    with pytest.raises(Exception, match="damaged payload of <urn:x-page:7>"):
        warc.page_records(warc.read_records(spark, path)).collect()
