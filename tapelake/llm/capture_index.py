"""WARC archives with a two-level capture index.

`write_archives` turns pages into WARC records, one gzip member each, in files that the tasks write to a shared folder.
Equal payloads of at least `min_bytes` bytes are stored once: the page of the largest id is a response, others are
revisits that refer to it. The captures (key, page id, file, offset, length) become a table.

`build_index` sorts the captures by reversed-host URL key, packs LINES_PER_BLOCK of them into a compressed block and
appends blocks to one index file per range of keys, followed by a sparse directory: the first key and place of each
block. A second, smaller directory, the table of the files' first keys, is one row per file.

`read_captures` routes keys to files by binary search in the second directory (FILES rows at most), opens a file's
own directory, binary-searches it, range-reads only the blocks that can hold the key and then the records they name.

Files go through pyarrow.fs, so the shared folder may be in any store that it reads. A task writes to files of new
names and only the names it returns are read, so a task that runs twice leaves a file nobody reads.

NULL payloads are empty. A NULL url has the key ''. Rows of a NULL page id are never the response of a group that has
another; a group of NULL ids only is all responses, as are repeated rows of the largest id. Empty tables give an empty index.
"""

from __future__ import annotations

import bisect
import functools
import gzip
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.session import scratch_dir, written

MIN_BYTES = 1000
LINES_PER_BLOCK = 512
FILES = 1024  # index files at most; the directory of files is broadcast
ARCHIVE_BYTES = 1 << 30  # an archive is closed beyond this size
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
CAPTURES = ("key string, page_id {kind}, url string, record_type string, refers_to {kind}, payload_bytes long, "
            "payload_digest string, file string, offset long, length long")


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@functools.lru_cache(maxsize=64)
def _reader(path: str):
    store, name = _open(path)
    return store.open_input_file(name)


def _range(path: str, offset: int, length: int) -> bytes:
    return _reader(path).read_at(length, offset)


def url_key(url):
    """Reversed host, then the rest: `com,example,www)/path?query` in lower-case ASCII letters of the host."""
    host = F.translate(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*(.*)", 1)
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.concat(turned, F.lit(")"), rest)).otherwise(url), F.lit(""))


def _record(kind: str, page_id, url: str, size: int, digest: str, payload: bytes | None, refers_to) -> bytes:
    """One WARC record as a gzip member. The HTTP head keeps the full payload's length, also in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE,
            "WARC-Target-URI": urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))),
            "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": json.dumps(page_id)}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 "X-Refers-To-Page-ID": json.dumps(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    first, *fields = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in fields)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def decided(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """Pages with payload, digest and the response they refer to. Only groups of equal payloads are joined."""
    own = pages.select(F.col(page_id).alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), url_key(F.col(url)).alias("key"),
                       F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    large = own.where(F.octet_length("payload") >= min_bytes)
    groups = written(large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select("digest", "first"), "payloads")
    both = own.join(groups, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return both.select("page_id", "url", "key", "digest", refers.alias("refers_to"), F.octet_length("payload").cast("long").alias("size"),
                       F.when(refers.isNull(), F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives below `folder`; the captures, one row per page, as a written table."""
    rows = decided(pages, page_id, url, html, min_bytes)
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            places = []
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for page, link, _, digest, refers, size, payload in zip(*columns, batch.column(6)):
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = _record("response" if refers is None else "revisit", page, link, size, digest, payload.as_py(), refers)
                out.write(member)
                places.append((name, offset, len(member)))
                offset += len(member)
            kinds = ["response" if r is None else "revisit" for r in columns[4]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), batch.column(1), pa.array(kinds, pa.string()), batch.column(4), batch.column(5),
                 batch.column(3), *map(pa.array, zip(*places))] if places else
                [pa.array([], t) for t in (pa.string(), batch.column(0).type, pa.string(), pa.string(), batch.column(4).type,
                                           pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())],
                ["key", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "offset", "length"])
        if out is not None:
            out.close()

    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    return written(rows.mapInArrow(run, CAPTURES.format(kind=kind)), "captures")


def build_index(captures: DataFrame, folder: str, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Writes index files of sorted, compressed blocks; the directory of files (first_key, last_key, file, directory offset)."""
    lines = captures.select("key", F.to_json(F.struct("page_id", "file", "offset", "length")).alias("line"))
    files = min(FILES, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = lines.repartitionByRange(files, "key", "line").sortWithinPartitions("key", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        out, name, offset, directory, held, last = None, f"index-{uuid.uuid4().hex}.gz", 0, [], [], None

        def flush():
            nonlocal out, offset, held
            if out is None:
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            block = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            directory.append((held[0][0], offset, len(block)))
            out.write(block)
            offset += len(block)
            held = []

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((key, line))
                last = key
                if len(held) == lines_per_block:
                    flush()
        if held:
            flush()
        if out is not None:
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed + struct.pack("<QQ", offset, len(packed)))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first_key": directory[0][0], "last_key": last, "file": name,
                                               "offset": offset, "length": len(packed)}])

    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    return written(ordered.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long"), "index")


@functools.lru_cache(maxsize=32)
def _directory(path: str, offset: int, length: int) -> tuple[list[str], list[list]]:
    rows = json.loads(zlib.decompress(_range(path, offset, length)))
    return [r[0] for r in rows], rows


@functools.lru_cache(maxsize=32)
def _block(path: str, offset: int, length: int) -> tuple[list[str], list[str]]:
    rows = [json.loads(x) for x in zlib.decompress(_range(path, offset, length)).decode().split("\n")]
    return [r[0] for r in rows], [r[1] for r in rows]


def find(path: str, offset: int, length: int, key: str) -> Iterator[dict]:
    """Captures of a key in one index file: bisect the directory, read the blocks that can hold it, bisect within."""
    firsts, rows = _directory(path, offset, length)
    at = max(0, bisect.bisect_left(firsts, key) - 1)
    while at < len(rows) and firsts[at] <= key:
        keys, lines = _block(path, *rows[at][1:])
        for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
            yield json.loads(lines[i])
        at += 1


def read_captures(keys: DataFrame, index: DataFrame, index_folder: str, archive_folder: str, kind: str) -> DataFrame:
    """Every capture of the keys in `key` (distinct), read back from the archives and checked against its digest.

    Keys meet the index files that may hold them; a key whose captures go over several files meets each. A file of the index is
    read by as many tasks as its keys are dealt to, in key order, so that neighbouring keys share the block last read.
    """
    files = sorted(tuple(r) for r in index.select("first_key", "last_key", "file", "offset", "length").collect())  # FILES at most
    lasts = [f[1] for f in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = []
            for key in batch.column(0).to_pylist():
                at = bisect.bisect_left(lasts, key)  # the first file that does not end before the key
                while at < len(files) and files[at][0] <= key:
                    met.append((key, *files[at][2:]))
                    at += 1
            columns = list(zip(*met)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                             ["key", "file", "offset", "length"])

    met = keys.mapInArrow(route, "key string, file string, offset long, length long")
    met = met.repartitionByRange("file", "key").sortWithinPartitions("file", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                for capture in find(f"{index_folder}/{name}", offset, length, key):
                    member = _range(f"{archive_folder}/{capture['file']}", capture["offset"], capture["length"])
                    fields, http, payload = parse_record(member)
                    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{capture}: the payload isn't what its digest says")
                    out.append((key, json.loads(fields["X-Page-ID"]), fields["WARC-Type"], digest, int(http["Content-Length"]),
                                json.loads(fields["X-Refers-To-Page-ID"]) if revisit else None, None if revisit else payload))
            for start in range(0, len(out), 256):  # payloads may be long
                part = zip(*out[start:start + 256])
                types = (pa.string(), ids, pa.string(), pa.string(), pa.int64(), ids, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)],
                                                 ["key", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    ids = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    return met.mapInArrow(run, f"key string, page_id {kind}, record_type string, payload_digest string, payload_bytes long, "
                               f"refers_to {kind}, payload binary")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the pages, indexes them and reads every capture back through the index."""
    base = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, f"{base}/archives", page_id, url, html, min_bytes)
    index = build_index(captures, f"{base}/index")
    kind = pages.schema[page_id].dataType.simpleString()
    return read_captures(captures.select("key").distinct(), index, f"{base}/index", f"{base}/archives", kind)
