"""WARC archives with a two-level capture index.

Pages are written as WARC 1.1 records, each a gzip member of its own, so that a record can be read
by file, offset and length. Of pages with equal payloads of some size one is a response; the others
are revisits that name it. Which one is settled on thin rows before any payload moves.

The index is sorted by reversed-host key and page number. Its lines lie in compressed blocks, and
a sparse directory names each block's first line, file, offset and length. A search goes through
the first lines of the index's parts, at most ``MOST_PARTS``, to a part, by binary search through
the part's directory to a block, reads that range, searches in it, and reads the record's range. Searches
run in bulk: they are dealt by part, and the ranges found are read in the order of the archives.

Archives and blocks go to the shared folder through Arrow's file systems (local or mounted
paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:`` and the like). Each attempt of a task writes files of its
own name, and only those of attempts that Spark has committed are named in the tables that follow,
so a lost executor leaves unused files behind and nothing else.

Defined cases: a null payload is empty; an empty or short payload is always a response; a null url
has an empty key and no target in its record; control characters and spaces of a url are percent-encoded;
of equal payloads the largest page number is the response, then the greatest url, nulls being
least, then any one of rows repeated in full, which are records of their own; a null page number
is written as ``-`` and read back as null; an empty table gives an empty result; further
columns, whatever their names, are ignored. One record is held in memory at a time, a payload whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.scratch import forget, give_back, shared_dir, stage

LEAST_PAYLOAD = 1000
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 1000
PART_BLOCKS, MOST_PARTS = 1000, 10_000
#: Bytes of neighbouring records that are read at once.
READ_BYTES = 4 << 20
#: Parts in which rows of one payload meet the name of their response.
PARTS = 16
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  #: pages carry none
CAPTURES = "line_key string, file string, offset long, length long"
BLOCKS = "first string, file string, offset long, length long, lines long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def files_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if local := re.fullmatch(r"(?:file:(?://)?)?(/.*)", uri):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def safe(url: str) -> str:
    return _UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", url)


def url_key(url: str | None) -> str:
    """The host, reversed, then path and query: ``http://www.Example.com/a?b#c`` is ``com,example,www)/a?b``."""
    if url is None:
        return ""
    scheme, found, rest = safe(url).partition("://")
    if not found:
        return f"){scheme}"
    rest = rest.partition("#")[0]
    host = re.match(r"[^/?]*", rest)[0]
    name, _, port = host.rpartition("@")[2].lower().partition(":")
    return f"{','.join(reversed(name.split('.')))}{':' + port if port else ''}){rest[len(host) :]}"


def line_key(url: str | None, page: int | None) -> str:
    """What index lines are sorted by: no key has a space, and numbers have equal length."""
    return f"{url_key(url)} {'-' if page is None else format(page + (1 << 63), '020d')}"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _name(page: int | None, digest: str, own: str = "") -> str:
    return f"<urn:x-page:{'-' if page is None else page}:{digest}{own}>"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, response: int | None, named: bool, revisit: bool) -> bytes:
    """A response, ``named`` if others refer to it, or a revisit of page ``response``: its HTTP head alone, which still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = _name(page, digest, "" if named else f":{uuid4().hex}")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", safe(url)))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(response, digest))]
    return _member(headers, http if revisit else http + payload)


def _page_of(name: str) -> int | None:
    page = name.strip("<>").split(":")[2]
    return None if page == "-" else int(page)


def read_record(member: bytes) -> dict:
    """A page record from its gzip member; its lengths and, for a response, its digest are checked."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    length = int(fields["Content-Length"])
    block, end = rest[:length], rest[length:]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if version != VERSION or len(block) != length or end != b"\r\n\r\n" or (kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest)):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


class _Output:
    """A file that a task writes in ranges, under a name no other attempt has."""

    def __init__(self, folder: str, kind: str):
        self.files, at = files_of(folder)
        self.files.create_dir(at, recursive=True)
        self.name, self.size = f"{kind}-{uuid4().hex}.gz", 0
        self.out = self.files.open_output_stream(f"{at}/{self.name}", compression=None)

    def add(self, data: bytes) -> tuple[str, int, int]:
        self.out.write(data)
        self.size += len(data)
        return self.name, self.size - len(data), len(data)


def _write_archives(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out, rows = None, []
        for batch in batches:
            for i in range(len(batch)):
                page, url, payload, digest, response, named, revisit = (batch.column(k)[i].as_py() for k in range(7))
                if out is None:
                    out = _Output(folder, "archive.warc")
                    out.add(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                rows.append((line_key(url, page), *out.add(page_record(page, url, payload, digest, response, named, revisit))))
                if out.size >= archive_bytes:
                    out.out.close()
                    yield _table(CAPTURES, rows)
                    out, rows = None, []
        if out:
            out.out.close()
            yield _table(CAPTURES, rows)
        give_back()

    return run


def _told_apart(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page, url, payload, digest, response, named, revisit) of every row; revisits refer to ``response``, whose record is ``named``."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    same = ["digest", "size", "check"]
    with_digest = rows.select("page", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("check"))
    times = with_digest.where(F.col("size") >= least).groupBy(*same, "page", "url").agg(F.count("*").alias("times"))
    repeats = stage(times.groupBy(*same).agg(F.sum("times").alias("members"), F.max(F.struct("page", "url", "times")).alias("best")).where("members > 1"), "warc-repeats")

    marks = repeats.select(*same, F.col("best.page").alias("response"), F.col("best.url").alias("best_url"), F.col("best.times").alias("times"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    told = with_digest.withColumn("part", F.pmod(F.xxhash64("page", "url"), F.lit(PARTS)).cast("int")).join(marks, [*same, "part"], "left")
    repeated = F.col("times").isNotNull()
    best = repeated & F.col("page").eqNullSafe(F.col("response")) & F.col("url").eqNullSafe(F.col("best_url"))
    columns = lambda df, named, revisit: df.select("page", "url", "payload", "digest", F.when(revisit, F.col("response")).alias("response"), named.alias("named"), revisit.alias("revisit"))
    whole = columns(told.where(~(best & (F.col("times") > 1))), best, repeated & ~best)
    # responses that are themselves repeated in full can't be told apart as rows: one of each is moved, and counted out again
    tied = repeats.where("best.times > 1").select(*same, F.col("best.page").alias("p"), F.col("best.url").alias("u"))
    if tied.isEmpty():
        return whole
    alike = with_digest.join(tied, same).where(F.col("page").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")))
    once = alike.groupBy("page", "url", "digest").agg(F.first("payload").alias("payload"), F.count("*").alias("times")).withColumn("response", F.col("page"))
    copies = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return whole.unionByName(columns(copies, F.col("copy") == 1, F.col("copy") > 1))


@dataclass(frozen=True)
class Index:
    """Where archives and blocks lie, the written directory of blocks, and the first line of each part."""

    folder: str
    directory: DataFrame
    bounds: list[str]
    partitions: int


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` to archives in ``folder``; returns the written captures."""
    return stage(_told_apart(pages, id_col, url_col, html_col, least).mapInArrow(_write_archives(folder, archive_bytes), CAPTURES), "warc-captures")


def _write_blocks(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        entries = (e for batch in batches for e in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, rows = None, []
        while some := list(islice(entries, lines)):
            out = out or _Output(folder, "index.cdx")
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress("".join(f"{key} {file} {offset} {length}\n" for key, file, offset, length in some).encode()) + packer.flush()
            rows.append((f"{some[0][0]} ", *out.add(data), len(some)))
        if out:
            out.out.close()
            yield _table(BLOCKS, rows)
        give_back()

    return run


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES, part_blocks: int = PART_BLOCKS) -> Index:
    """Sorts the captures into blocks of ``lines`` lines; a part is a range of keys, in one file."""
    parts = max(1, min(MOST_PARTS, -(-captures.count() // (lines * part_blocks))))
    ordered = captures.repartitionByRange(parts, "line_key", "file", "offset").sortWithinPartitions("line_key", "file", "offset")
    directory = stage(ordered.mapInArrow(_write_blocks(folder, lines), BLOCKS), "warc-directory")
    bounds = sorted((first, file) for file, first in directory.groupBy("file").agg(F.min("first")).collect())
    numbers = directory.sparkSession.createDataFrame([(file, i) for i, (_, file) in enumerate(bounds)], "file string, part int")
    directory = directory.join(numbers, "file")
    return Index(folder, directory, [first for first, _ in bounds], parts)


def _parts_of(bounds: list[str]):
    """Each search (prefix of index lines) with every part that may hold such lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            rows = [(i, q) for q in wanted for i in range(max(bisect_left(bounds, q) - 1, 0), bisect_right(bounds, q + "\U0010ffff"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["part", "prefix"])

    return run


def _search(folder: str):
    """Rows sorted by part, a part's directory before its searches; (file, offset, length) of the captures found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        files, at = files_of(folder)
        part, firsts, places, opened, lines, shown, last = None, [], [], None, [], None, None
        for batch in batches:
            found = []
            for number, prefix, first, file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if number != part:
                    part, firsts, places, opened, shown, last = number, [], [], None, None, None
                if prefix is None:
                    firsts.append(first)
                    places.append((file, offset, length))
                    continue
                if prefix == last:
                    continue
                last, block = prefix, max(bisect_left(firsts, prefix) - 1, 0)
                while block < len(firsts) and (firsts[block] < prefix or firsts[block].startswith(prefix)):
                    if shown != block:
                        file, offset, length = places[block]
                        opened = opened or files.open_input_file(f"{at}/{file}")
                        lines, shown = zlib.decompress(opened.read_at(length, offset), 31).decode().split("\n")[:-1], block
                    i = bisect_left(lines, prefix)
                    while i < len(lines) and lines[i].startswith(prefix):
                        _, _, file, offset, length = lines[i].split(" ")
                        found.append((file, int(offset), int(length)))
                        i += 1
                    block += 1
            yield _table("file string, offset long, length long", found)
        give_back()

    return run


def _read(folder: str, payloads: bool):
    """Records by (file, offset, length), given in that order; neighbours are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        files, at = files_of(folder)
        name = opened = None
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            ranges = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i, rows, size = 0, [], 0
            while i < len(ranges):
                file, offset, length = ranges[i]
                end, j = offset + length, i + 1
                while j < len(ranges) and ranges[j][0] == file and ranges[j][1] == end and end - offset < READ_BYTES:
                    end, j = end + ranges[j][2], j + 1
                if file != name:
                    name, opened = file, files.open_input_file(f"{at}/{file}")
                data = memoryview(opened.read_at(end - offset, offset))
                for _, begin, long in ranges[i:j]:
                    record = read_record(data[begin - offset : begin - offset + long])
                    if not payloads:
                        record["payload"] = None
                    rows.append(tuple(record[n] for n in names))
                    size += len(record["payload"] or b"")
                if size >= READ_BYTES or len(rows) >= 5000:
                    yield _table(RECORDS, rows)
                    rows, size = [], 0
                i = j
            if rows:
                yield _table(RECORDS, rows)
        give_back()

    return run


def find_captures(index: Index, searches: DataFrame) -> DataFrame:
    """(file, offset, length) of all captures whose index line begins with a ``prefix`` of ``searches``, each once per prefix."""
    told = searches.select("prefix").mapInArrow(_parts_of(index.bounds), "part int, prefix string")
    nothing = lambda *kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds]
    asked = told.select("part", "prefix", *nothing(("first", "string"), ("file", "string"), ("offset", "long"), ("length", "long")))
    known = index.directory.select("part", F.lit(None).cast("string").alias("prefix"), "first", "file", "offset", "length")
    dealt = known.unionByName(asked).repartition(index.partitions, "part").sortWithinPartitions("part", F.asc_nulls_first("prefix"), "first")
    return dealt.mapInArrow(_search(index.folder), "file string, offset long, length long")


def read_captures(index: Index, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``captures`` (file, offset, length), as in ``RECORDS``; without ``payloads`` that column is null."""
    return captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_read(index.folder, payloads), RECORDS)


def _prefixes(with_page: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{line_key(url, page) if with_page else url_key(url)} " for page, url in rows], pa.string())], names=["prefix"])

    return run


def captures_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Searches for each row's own captures."""
    return pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url")).mapInArrow(_prefixes(True), "prefix string")


def captures_of_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Searches for all captures of each url."""
    return urls.select(F.lit(None).cast("long").alias("page"), F.col(url_col).cast("string").alias("url")).mapInArrow(_prefixes(False), "prefix string")


def archived(pages: DataFrame, folder: str | None = None, payloads: bool = False, lines: int = BLOCK_LINES, part_blocks: int = PART_BLOCKS, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes ``pages``, indexes the archives, and reads every row's record back through the index."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid4().hex}"
    index = build_index(write_archives(pages, folder, least=least, archive_bytes=archive_bytes), folder, lines, part_blocks)
    return read_captures(index, find_captures(index, captures_of_pages(pages)), payloads)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    read = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM m
"""
