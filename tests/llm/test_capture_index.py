"""WARC archives and their index: exact round trips, and lookups against a scan."""

import base64
import hashlib
import tempfile
import zlib

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from fablespark.llm import capture_index
from fablespark.llm.capture_index import Shard, capture_of, find_captures, parse_record, read_captures, url_key, url_keys, warc_record, write_captures

SCHEMA = "page_id long, url string, html string, hash string, key string, archive int, n int"


def expected(rows, min_bytes=0):
    largest, count = {}, {}
    for page_id, _, html in rows:
        h = html or ""
        count[h] = count.get(h, 0) + 1
        largest[h] = max((x for x in (largest.get(h), page_id) if x is not None), default=None)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        top = largest[html or ""]
        revisit = len(payload) >= min_bytes and count[html or ""] > 1 and top is not None and page_id != top
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def read_back(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "h", "k", 1, 2) for r in rows], SCHEMA)
    index = write_captures(pages, **options)
    return index, read_captures(index, find_captures(index, url_keys(pages)), with_html=True)


ODD = [
    (1, "http://Www.Example.com/a b\n?x=1#f", "<p>é</p>"), (2, None, None), (3, "no scheme", ""), (4, "https://www.example.com", "<p>é</p>"), (5, "http://example.com/\u2028\x85", "x" * 300_000),
    (None, "http://a.b", "<p>é</p>"), (7, "http://a.b", "same"), (7, "http://a.b", "same"), (7, "http://a.b", "other"), (6, "http://b", "same"), (8, "", "\r\n\r\nWARC/1.1\r\n"), (None, None, "alone"),
]


@pytest.fixture(params=[512, 2])
def blocks(request, monkeypatch):
    monkeypatch.setattr(capture_index, "BLOCK_LINES", request.param)
    monkeypatch.setattr(capture_index, "ARCHIVE_BYTES", 1_000_000_000 if request.param > 2 else 700)


def test_odd_rows(spark, blocks):
    _, found = read_back(spark, ODD)
    rows = found.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr) == expected(ODD)
    assert sorted((r["html"] for r in rows if r["html"] is not None)) == sorted([h or "" for p, _, h in ODD if (h or "") not in ("<p>é</p>", "same", "")] + ["<p>é</p>", "same", "same", ""])
    assert {r["page_id"]: r["url"] for r in rows if r["page_id"] in (1, 2, 4)} == {1: "http://Www.Example.com/a%20b%0A?x=1#f", 2: None, 4: "https://www.example.com"}


def test_min_bytes(spark):
    _, found = read_back(spark, ODD, min_bytes=5)
    assert sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(ODD, 5)


def test_hot_url_and_payload_over_many_shards(spark, blocks):
    rows = [(i, "http://hot.example.org/" if i % 3 == 0 else f"http://h{i % 50}.example.org/p{i}", "hot" if i % 3 == 1 else f"page {i}") for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index, found = read_back(spark, rows)
        assert sum(first <= 'org,example,hot)/' <= last for first, last, *_ in index.shards) > 1
        assert sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(rows)
        keys = spark.createDataFrame([("org,example,hot)/",), ("org,example,h7)/p7",), ("org,example,h7)/p",), ("zz",), (None,), ("org,example,hot)/",)], "key string")
        assert sorted(r["page_id"] for r in find_captures(index, keys).collect()) == sorted([7] + list(range(0, 900, 3)))
        under = spark.createDataFrame([("org,example,h7)",)], "key string")
        assert sorted(r["page_id"] for r in find_captures(index, under, prefix=True).collect()) == [i for i in range(900) if i % 50 == 7 and i % 3]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_lookup_fetches_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(capture_index, "BLOCK_LINES", 10)
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.format_string("http://x.org/%05d", "id").alias("url"), F.lit("t").alias("html")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        index = write_captures(pages)
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
    (_, _, name, tail), = index.shards
    shard = Shard(pafs.FileSystem.from_uri(index.folder)[0], f"{pafs.FileSystem.from_uri(index.folder)[1]}/{name}", tail)
    assert len(shard.firsts) == 100
    for i in (0, 9, 10, 555, 999):
        shard.fetched, shard.at = 0, -1
        assert [x[1] for x in shard.find(f"org,x)/{i:05d}")] == [i] and shard.fetched <= 2
    assert [list(shard.find(k)) for k in ("", "org,x)/00005x", "zzz")] == [[], [], []]


def test_records_are_whole_warc(spark):
    member = capture_index._gzip(warc_record(5, "http://a.b/", "ü".encode(), "D" * 32, None, False, "2020-01-01T00:00:00Z"))
    fields, http, payload = parse_record(member)
    assert fields["warc-type"] == "response" and fields["content-length"] == str(len(http) + 4 + 2) and payload == "ü".encode()
    with pytest.raises(ValueError, match="damaged"):
        capture_of(member, True)
    with pytest.raises(ValueError, match="bytes long"):
        parse_record(capture_index._gzip(zlib.decompress(member, 31)[:-5]))


def test_archive_reads_from_its_start(spark):
    folder = tempfile.mkdtemp(prefix="spark-warc-")
    index, _ = read_back(spark, ODD, folder=folder)
    names = [f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(index.folder)) if f.path.endswith(".warc.gz")]
    seen = 0
    for name in names:
        data = open(name, "rb").read()
        while data:  # each record is a gzip member of its own
            z = zlib.decompressobj(31)
            seen += b"WARC-Type: warcinfo" not in z.decompress(data)
            data = z.unused_data
    assert seen == len(ODD)


def test_url_keys():
    assert [url_key(u) for u in ("http://Www.Example.COM:80/A?b#c", "x://a?q", "plain", None, "http://")] == ["com:80,example,www)/A?b#c", "a)?q", "plain", "", ")"]


def test_empty_table(spark):
    pages = spark.createDataFrame([], SCHEMA)
    index = write_captures(pages)
    assert index.shards == () and read_captures(index, find_captures(index, url_keys(pages))).count() == 0
