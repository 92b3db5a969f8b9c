"""WARC archives with a two-level capture index.

``write_archive`` writes a WARC record for each page, every record a gzip member
of its own, so that it can be read alone by its byte range.  Of pages with equal
payloads (equal SHA-1 and length) of ``least`` bytes or more, the one with the largest id
is a response record; the others are revisit records, which hold the HTTP header
and refer to it.  Which payloads repeat comes from a partial
aggregation; the table of repeated ones is written and joined to the pages.

``write_index`` sorts the captures by reversed-host URL key (``com,example)/path``)
over ranges.  Each range is an index file of compressed blocks of ``LINES`` capture
lines, with a sparse block directory beside it: first key, place and length of each block.

``lookup`` finds the captures of URLs: a binary search over the ranges' first
and last keys (one row an index file, in every task), one in the block directory
of the file, then a range read of the blocks that can hold the key and a binary
search in each.  A key that fills many blocks becomes many reads, spread over
tasks by block.  ``read_records`` reads captures' records by byte range, sorted
by place in their file, checks the digest of every payload, and parses them.

Files carry names of their own for each attempt, and only those named in the
written tables count, so a lost executor leaves no half file in the archive.

Defined cases: a null payload is empty; a null id is allowed (it is a revisit
where an equal payload has an id, else a response); rows that share the largest
id and the payload are all responses; a null URL has the key ``-`` and no
target header; white space and control characters of URLs are escaped in keys and headers; texts
of any length are one record (a row's payload is in memory once); an empty table
gives no files and no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, partitions, scratch_path, slices, table, written
from .files import Ranges, new_file, store

#: Lines of a block of the index.
LINES = 3000
#: Bytes after which a task begins a further archive file.
FILE_BYTES = 1 << 30
#: Bytes of an archive file whose records one group of reads takes.
READ_BYTES = 16 << 20
LEVEL = 4
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PORTS = {"http": "80", "https": "443"}


# ---- keys and records -----------------------------------------------------------------------------

def escaped(url: str) -> str:
    """The URL without white space and control characters."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def url_key(url: str | None) -> str:
    """Reversed-host key: no scheme, user, ``www.``, default port or fragment; the host in lower case."""
    if url is None:
        return "-"
    clean = escaped(url.strip())
    try:
        parts = urlsplit(clean)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return clean or "-"
    host = re.sub(r"^www\d*\.", "", host.rstrip("."))
    key = ",".join(reversed(host.split(".")))
    if port is not None and str(port) != PORTS.get(parts.scheme):
        key += f":{port}"
    return f"{key}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def digest_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One compressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page is None else page
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {escaped(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _headers(text: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.decode().split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parsed(data: bytes) -> dict:
    """page_id, url, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to of one record."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = _headers(head)
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its header says")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size, digest, kind = int(_headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest_of(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"a payload differs from its digest {digest}")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": _page(fields.get("warc-refers-to"))}


# ---- writing ----------------------------------------------------------------------------------------

_CAPTURE = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()),
                      ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURE_SQL = "surt string, page_id long, url string, record_type string, digest string, file string, offset long, length long"


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write the records to files in ``folder``; the captures, one row a page: surt, page_id, url,
    record_type, digest, file, offset, length."""
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    sha, size = F.unhex(F.sha1("payload")), F.octet_length("payload")
    repeated = rows.select("page", sha.alias("s"), size.alias("b")).where(F.col("b") >= least).groupBy("s", "b").agg(
        F.max("page").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    repeated = written(repeated.select("s", "b", "top"), "op11-repeated")  # written first: its size decides how it is joined
    rows = rows.withColumns({"sha": sha, "size": size}).join(repeated, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("b")), "left")
    rows = rows.select("page", "url", "payload", "sha", "top", (F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, at = None, 0
        for batch in slices(batches, "payload"):
            made = []
            for page, u, data, s, top, revisit in zip(*(column(batch, c).to_pylist() for c in ("page", "url", "payload", "sha", "top", "revisit"))):
                if handle is None or at > FILE_BYTES:
                    if handle is not None:
                        handle.close()
                    path, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    handle = new_file(path)
                digest = digest_of(s)
                packed = record(page, u, data, digest, top, revisit)
                handle.write(packed)
                made.append((url_key(u), page, u, "revisit" if revisit else "response", digest, path, at, len(packed)))
                at += len(packed)
            if made:
                yield batch_of(_CAPTURE, [list(c) for c in zip(*made)])
        if handle is not None:
            handle.close()

    return written(rows.mapInArrow(run, _CAPTURE_SQL), "op11-captures")


_SHARD = pa.schema([("path", pa.string()), ("least", pa.string()), ("most", pa.string()), ("blocks", pa.int64()), ("lines", pa.int64())])


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write index files and their block directories; one row a file: path, least, most (keys), blocks, lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/captures-{uuid.uuid4().hex}.cdx.gz"
        handle, at, block, directory, lines = None, 0, [], [], 0
        least = most = None

        def flush() -> None:
            nonlocal at
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            packed = packer.compress("".join(f"{k} {rest}\n" for k, rest in block).encode()) + packer.flush()
            handle.write(packed)
            directory.append(f"{block[0][0]}\t{at}\t{len(packed)}\t{len(block)}\n")
            at += len(packed)
            block.clear()

        for batch in slices(batches, rows=4096):
            if handle is None:
                handle = new_file(path)
            for r in batch.to_pylist():
                least = r["surt"] if least is None else least
                most = r["surt"]
                block.append((most, json.dumps({c: r[c] for c in ("url", "record_type", "digest", "file", "offset", "length")})))
                lines += 1
                if len(block) == LINES:
                    flush()
        if handle is not None:
            if block:
                flush()
            handle.close()
            with new_file(path + ".idx") as f:
                f.write("".join(directory).encode())
            yield batch_of(_SHARD, [[path], [least], [most], [len(directory)], [lines]])

    ordered = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return written(ordered.mapInArrow(run, "path string, least string, most string, blocks long, lines long"), "op11-index")


# ---- reading ----------------------------------------------------------------------------------------

class Directory:
    """The sparse block directory of one index file."""

    def __init__(self, path: str):
        fs, local = store(path + ".idx")
        with fs.open_input_stream(local) as f:
            rows = [line.split("\t") for line in f.read().decode().split("\n")[:-1]]
        self.firsts = [r[0] for r in rows]
        self.places = [(int(r[1]), int(r[2])) for r in rows]

    def blocks(self, key: str) -> list[tuple[int, int]]:
        """Place and length of the blocks that can hold the key."""
        lo = max(0, bisect_left(self.firsts, key) - 1)
        return self.places[lo:bisect_right(self.firsts, key)]


def _line_key(line: str) -> str:
    return line.partition(" ")[0]


def in_block(lines: list[str], key: str) -> list[dict]:
    """The captures of a key in a sorted block."""
    lo, hi = bisect_left(lines, key, key=_line_key), bisect_right(lines, key, key=_line_key)
    return [json.loads(line.partition(" ")[2]) for line in lines[lo:hi]]


def lookup(urls: DataFrame, index: DataFrame, url: str = "url") -> DataFrame:
    """surt, file, offset, length of all captures of the URLs (a column ``url``), each once."""
    shards = sorted((r.least, r.most, r.path) for r in index.collect())  # a row an index file
    leasts, mosts = [s[0] for s in shards], [s[1] for s in shards]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096):
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in column(batch, "url").to_pylist()], pa.string())], names=["surt"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("surt", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
        last = directory = None
        for batch in slices(batches, rows=1024):
            made = []
            for key in column(batch, "surt").to_pylist():
                for s in range(bisect_left(mosts, key), bisect_right(leasts, key)):
                    path = shards[s][2]
                    if path != last:
                        last, directory = path, Directory(path)
                    made += [(key, path, at, length) for at, length in directory.blocks(key)]
            for lo in range(0, len(made), 4096):
                yield batch_of(out, [list(c) for c in zip(*made[lo:lo + 4096])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("surt", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        ranges, last, lines = Ranges(), None, []
        for batch in slices(batches, rows=1024):
            for key, path, at, length in zip(*(column(batch, c).to_pylist() for c in ("surt", "path", "at", "length"))):
                if (path, at) != last:
                    last = path, at
                    lines = zlib.decompress(ranges.read(path, at, length), 31).decode().split("\n")[:-1]
                found = in_block(lines, key)  # a block's lines at most
                if found:
                    yield batch_of(out, [[key] * len(found), *([f[c] for f in found] for c in ("file", "offset", "length"))])
        ranges.close()

    wanted = urls.select(F.col(url).cast("string").alias("url")).mapInArrow(keys, "surt string").distinct()
    # sorted keys, so that a task opens each directory once
    blocks = wanted.repartitionByRange("surt").sortWithinPartitions("surt").mapInArrow(find, "surt string, path string, at long, length long")
    blocks = blocks.repartition(partitions(urls.sparkSession), "path", "at").sortWithinPartitions("path", "at", "surt")
    return blocks.mapInArrow(_joined(read, 4096), "surt string, file string, offset long, length long")


def _joined(run, rows: int):
    """``run`` with its small batches put together."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return joined


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_records(captures: DataFrame) -> DataFrame:
    """The parsed records (see ``parsed``) of captures (file, offset, length)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in slices(batches, rows=64):
            found = [parsed(ranges.read(*place)) for place in zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length")))]
            yield batch_of(_RECORD, [[f[c] for f in found] for c in _RECORD.names])
        ranges.close()

    near = captures.select("file", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("part"))
    # a set number of partitions: rows are small, but each stands for a record
    ordered = near.repartition(partitions(captures.sparkSession), "file", "part").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return ordered.mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Registered query: every page's record, found by its URL in the index and read back from the archive."""
    pages, folder = table(spark, sf_dir, "pages"), scratch_path(spark, "op11")
    index = write_index(write_archive(pages, folder), folder)
    return read_records(lookup(pages, index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, top,
         top IS NOT NULL AND page_id IS DISTINCT FROM top AS again
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to
FROM d
"""
