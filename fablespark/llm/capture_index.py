"""WARC archives of pages, and a two-level index that finds a record without reading an archive.

**Archives.** Each task writes its pages as WARC/1.1 records, one gzip member a record,
to files of its own (``ARCHIVE_BYTES`` at most, but for one record) in the shared folder. Of records with equal
payloads, that of the largest page_id is a ``response``; the others are ``revisit``
records that name it and hold no payload. Equal means an equal SHA-256; groups are
found by partial aggregation, and only payloads that occur more than once are joined
back, a join that adaptive execution can split where one payload is hot.

**Index.** A capture's key is its url with the host's labels reversed
(``com,example,www)/a?b``), so that a host and its subdomains are one range. Index lines
are sorted over the cluster by key; each partition writes one shard: blocks of
``BLOCK_LINES`` lines, compressed one by one, and a sparse directory, the first key and
the byte range of each block. The driver knows one row a shard (first and last key,
path), as many as the session's shuffle partitions.

**Reading.** A wanted key finds its shards by binary search, then, in the task that has the
shard, its block by binary search in the directory and its lines by binary search in
the block, which is fetched by a range read. Captures are then dealt by archive and
place and read in byte ranges, neighbours together. A key that a third of all captures
have fills many shards, and each of its shards is another task.

Files are written and read with ``pyarrow.fs``, in tasks. A file's name is new for each
attempt of a task, and a file counts only if the task's rows came through, so a lost
executor or a second attempt leaves nothing that is read. Every table of file names is
written to the shared folder before it is used.

Cases: a null html is an empty payload; a null url has an empty key, and no url when
read back; control characters in a url are percent-encoded in its record; a null page_id is
less than any other; rows of equal page_id and payload are all responses, or all revisits;
payloads of fewer than ``min_bytes`` bytes are all responses; very long pages are records
like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.llm.common import checkpointed, shared_folder, shuffle_width

#: A task begins another archive beyond so many bytes.
ARCHIVE_BYTES = 1_000_000_000
BLOCK_LINES = 512
#: Captures whose gap is less are fetched with one read, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64_000, 8_000_000
#: Captures of so many bytes of an archive are read by one task.
REGION_BYTES = 4_000_000
GZIP_LEVEL = 4

# The WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"

LINES = "key string, page_id long, kind string, digest string, archive string, start long, length long"
_LINES = (["key", "page_id", "kind", "digest", "archive", "start", "length"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])
PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
_PAGES = (["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()])


def encoded_url(url: str) -> str:
    """``url`` without control characters and spaces, these percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def url_key(url: str | None) -> str:
    """Reversed host, ``)``, and the rest of the url; a url without ``://`` is its own key, null an empty one."""
    if url is None:
        return ""
    plain = encoded_url(url)
    _, mark, rest = plain.partition("://")
    if not mark:
        return plain
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, as in WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{page_id}:{digest}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {encoded_url(url)}"] if url is not None else []
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}:{digest}>"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, HTTP head and payload of a record's gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is not {size} bytes long")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def _page_of(record_id: str) -> int | None:
    page = record_id.strip("<>").removeprefix(_ID).split(":")[0]
    return None if page == "None" else int(page)


def capture_of(member: bytes, with_html: bool) -> tuple:
    """A row of ``PAGES``, all of it read from the record; a payload that its digest does not fit is an error."""
    fields, http, payload = parse_record(member)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]) if revisit else len(payload)
    refers = _page_of(fields["warc-refers-to"]) if revisit else None
    return _page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, fields["warc-type"], refers, payload.decode() if with_html and not revisit else None


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): refers_to is the largest page_id of the payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("hash", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    repeated = rows.filter(F.octet_length("html") >= min_bytes).groupBy("hash").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(repeated.select("hash", "largest").hint("shuffle_hash"), "hash", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))


def _writer(folder: str, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records to archives; index lines come out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        files, root = _open(folder)
        out, at, name = None, 0, ""
        try:
            for page_id, url, html, refers_to, revisit in _rows(batches):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"software: fablespark\r\nformat: WARC File Format 1.1\r\n"
                    start = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    at = out.write(first := _gzip(start.encode() + info + b"\r\n\r\n")) or len(first)
                payload = html.encode()
                digest = payload_digest(payload)
                member = _gzip(warc_record(page_id, url, payload, digest, refers_to, revisit, date))
                out.write(member)
                yield url_key(url), page_id, "revisit" if revisit else "response", digest, name, at, len(member)
                at += len(member)
        finally:
            if out is not None:
                out.close()

    return lambda batches: _batched(rows(batches), *_LINES)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives in ``folder`` (a URI or path that all executors share); returns their index lines, unsorted."""
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    return checkpointed(with_references(pages, min_bytes).mapInArrow(_writer(folder, date), LINES))


@dataclass(frozen=True)
class CaptureIndex:
    """Where the archives are, and (first key, last key, shard file, bytes of its directory) of each shard, in order of keys."""

    folder: str
    shards: tuple[tuple[str, str, str, int], ...]


def _sharder(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted lines to one shard: blocks, then the directory of first keys and byte ranges at the end of the file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        files, root = _open(folder)
        out, name, block, directory, at, first, last = None, f"{uuid.uuid4().hex}.cdx.gz", [], [], 0, None, None

        def flush() -> None:
            nonlocal at
            data = _gzip("".join(x for _, x in block).encode())
            directory.append(f"{block[0][0]}\t{at}\t{len(data)}\n")
            out.write(data)
            at += len(data)
            block.clear()

        for key, *rest in _rows(batches):
            if out is None:
                out, first = files.open_output_stream(f"{root}/{name}", compression=None), key
            block.append((key, "\t".join(map(str, (key, *rest))) + "\n"))
            last = key
            if len(block) == BLOCK_LINES:
                flush()
        if out is not None:
            if block:
                flush()
            ends = _gzip("".join(directory).encode())
            out.write(ends)
            out.close()
            yield first, last, name, len(ends)

    return lambda batches: _batched(rows(batches), ["first", "last", "name", "tail"], [pa.string(), pa.string(), pa.string(), pa.int64()])


def build_index(lines: DataFrame, folder: str) -> CaptureIndex:
    """Sort the index lines over the cluster and write a shard a partition."""
    ordered = lines.repartitionByRange("key", "page_id", "archive", "start").sortWithinPartitions("key", "page_id", "archive", "start")
    shards = checkpointed(ordered.mapInArrow(_sharder(folder), "first string, last string, name string, tail long"))
    # One row a shuffle partition.
    return CaptureIndex(folder, tuple(sorted((tuple(r) for r in shards.collect()), key=lambda s: (s[0].encode(), s[1].encode()))))


def write_captures(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> CaptureIndex:
    """Write archives and index of ``pages`` (page_id, url, html); the folder is the caller's to remove."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return build_index(write_archives(pages, folder, min_bytes), folder)


class Shard:
    """Looks keys up in one shard by binary search, fetching blocks by range reads."""

    def __init__(self, files: pafs.FileSystem, path: str, tail: int) -> None:
        self.file = files.open_input_file(path)
        size = self.file.size()
        entries = [x.split("\t") for x in zlib.decompress(self.file.read_at(tail, size - tail), 31).decode().split("\n")[:-1]]
        self.firsts = [e[0].encode() for e in entries]
        self.ranges = [(int(e[1]), int(e[2])) for e in entries]
        self.at, self.keys, self.lines = -1, [], []
        self.fetched = 0

    def _load(self, k: int) -> None:
        if k != self.at:
            start, length = self.ranges[k]
            self.lines = zlib.decompress(self.file.read_at(length, start), 31).decode().split("\n")[:-1]
            self.keys, self.at = [x[: x.index("\t")].encode() for x in self.lines], k
            self.fetched += 1

    def find(self, key: str, prefix: bool = False) -> Iterator[tuple]:
        """Lines of the key, or of all keys that begin with it."""
        wanted = key.encode()
        fits = (lambda k: k.startswith(wanted)) if prefix else (lambda k: k == wanted)
        # The block before the first that begins at the key or later may end with it.
        for b in range(max(0, bisect_left(self.firsts, wanted) - 1), len(self.firsts)):
            if self.firsts[b] > wanted and not fits(self.firsts[b]):
                return
            self._load(b)
            for i in range(bisect_left(self.keys, wanted), len(self.keys)):
                if not fits(self.keys[i]):
                    return
                key_, page_id, kind, digest, archive, start, length = self.lines[i].split("\t")
                yield key_, None if page_id == "None" else int(page_id), kind, digest, archive, int(start), int(length)


def find_captures(index: CaptureIndex, keys: DataFrame, prefix: bool = False) -> DataFrame:
    """Index lines of the wanted ``keys`` (key), each key once; with ``prefix`` of all keys that begin with one."""
    folder, shards = index.folder, index.shards
    firsts, lasts = [s[0].encode() for s in shards], [s[1].encode() for s in shards]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (key,) in _rows(batches):
                wanted = key.encode()
                k = bisect_left(lasts, wanted)
                while k < len(shards) and (firsts[k] <= wanted or prefix and firsts[k].startswith(wanted)):
                    yield k, key
                    k += 1

        return _batched(rows(), ["shard", "key"], [pa.int32(), pa.string()])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            files, root = _open(folder)
            at, shard = -1, None
            for k, key in _rows(batches):
                if k != at:
                    at, shard = k, Shard(files, f"{root}/{shards[k][2]}", shards[k][3])
                yield from shard.find(key, prefix)

        return _batched(rows(), *_LINES)

    wanted = keys.select("key").filter("key is not null").distinct()
    dealt = wanted.mapInArrow(deal, "shard int, key string")
    # The rows are small and the work is not, so partitions are not put together by their bytes.
    return dealt.repartition(shuffle_width(keys.sparkSession), "shard").sortWithinPartitions("shard", "key").mapInArrow(look_up, LINES)


def read_captures(index: CaptureIndex, captures: DataFrame, with_html: bool = False) -> DataFrame:
    """The records of ``captures`` (archive, start, length): page_id, url, payload_bytes, payload_digest, record_type, refers_to, html."""
    folder = index.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges() -> Iterator[tuple[str, list[tuple[int, int]]]]:
            """Captures of one archive that lie close together."""
            name, held = None, []
            for archive, start, length in _rows(batches):
                if held and (archive != name or start - sum(held[-1]) > GAP_BYTES or start + length - held[0][0] > READ_BYTES):
                    yield name, held
                    held = []
                name = archive
                held.append((start, length))
            if held:
                yield name, held

        def rows() -> Iterator[tuple]:
            files, root = _open(folder)
            name, file = None, None
            for archive, held in ranges():
                if archive != name:
                    name, file = archive, files.open_input_file(f"{root}/{archive}")
                begin = held[0][0]
                data = file.read_at(sum(held[-1]) - begin, begin)
                for start, length in held:
                    yield capture_of(data[start - begin : start - begin + length], with_html)

        return _batched(rows(), *_PAGES, size=500)

    dealt = captures.select("archive", "start", "length").repartition(shuffle_width(captures.sparkSession), "archive", F.floor(F.col("start") / REGION_BYTES))
    found = dealt.sortWithinPartitions("archive", "start").mapInArrow(read, PAGES)
    return found if with_html else found.drop("html")


def url_keys(urls: DataFrame) -> DataFrame:
    """(key) of each row's url."""
    work = lambda batches: _batched(((url_key(u),) for (u,) in _rows(batches)), ["key"], [pa.string()])
    return urls.select("url").mapInArrow(work, "key string")


ORACLE_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest, count(*) OVER (PARTITION BY coalesce(html, '')) AS n FROM pages),
coded AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS fives FROM payloads)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM coded
"""
