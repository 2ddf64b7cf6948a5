"""Operator 8, WARC: monolithic gzip archives, normalised.

Writing: a WARC/1.1 record per page; archives are gzip streams over whole
files, as some crawlers write them, which cannot be read from the middle.
The normaliser inflates such a stream once, front to back, holding one record
at a time, rewrites every record as a gzip member of its own and writes a
sidecar index (a JSON line per record: id, type, offset, length).  Reading
back goes by the index and decompresses single members.

Of pages with equal payloads of at least ``least`` bytes the one with the
largest page_id is a ``response``, the others are ``revisit`` records without
a payload that name it, its digest and its length; smaller payloads are all
responses.  Equal means the same SHA-1 and length.

Files are written under the shared folder by the tasks themselves, through
the file system of the folder's address, under names with the attempt in
them; a row with the names comes back, so what a lost attempt wrote is never
read.  An archive is closed at ``archive_bytes`` of records.

Null html counts as an empty payload, null urls as an empty target.  Of
repeated rows with the same page_id one is the response (the largest locator).
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import os
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, located, prepare, run_dir, save

LEAST, ARCHIVE_BYTES, LEVEL = 1000, 64 << 20, 3
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


def _file_system(address: str):
    """The file system of a folder's address, and its path there."""
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", address)
    if "://" not in address:
        return pafs.LocalFileSystem(), address
    return pafs.FileSystem.from_uri(address)


# --- records ------------------------------------------------------------------------------------
def record(page_id, key: str, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One record; ``refers`` (a response's key) makes it a revisit."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:page:{key}>",
            f"WARC-Date: {_DATE}", f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: '%' + m[0].encode().hex(), url)}",
            f"WARC-Payload-Digest: sha1:{sha}", f"X-Page-ID: {json.dumps(page_id)}",
            f"X-Payload-Length: {len(payload)}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_PROFILE}"]
    else:
        body += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:80]!r}")
    return dict(line.split(": ", 1) for line in lines[1:])


def records(chunks):
    """(headers, whole record) of each record in a stream of inflated bytes."""
    buf = bytearray()
    chunks = iter(chunks)

    def more():
        piece = next(chunks, None)
        if piece is None:
            return False
        buf.extend(piece)
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf:
                    raise ValueError("the archive ends inside a record's headers")
                return
        head = headers(bytes(buf[:end]))
        size = end + 4 + int(head["Content-Length"]) + 4
        while len(buf) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(buf[:size])
        del buf[:size]


def inflate(stream):
    """The bytes of a gzip stream, piece by piece; members follow each other."""
    z = zlib.decompressobj(31)
    while piece := stream.read(_READ):
        while piece:
            out = z.decompress(piece, _READ)
            if out:
                yield out
            piece = z.unconsumed_tail
            if z.eof:
                piece, z = z.unused_data, zlib.decompressobj(31)
    if tail := z.flush():
        yield tail


# --- jobs -----------------------------------------------------------------------------------------
def _name(kind: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex[:12]}"


def _write_archives(folder: str, archive_bytes: int, level: int):
    def run(batches):
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        out = z = None
        name, held, n = "", 0, 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])

        for b in batches:
            cols = [b.column(c) for c in ("page_id", "key", "url", "html", "digest", "refers")]
            for i in range(b.num_rows):
                page, key, url, html, digest, refers = (c[i].as_py() for c in cols)
                if out is None:
                    name, held, n = _name("crawl") + ".warc.gz", 0, 0
                    out, z = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, 8, 31)
                payload = (html or "").encode()
                written = record(page, key, url or "", payload, digest, refers)
                out.write(z.compress(written))
                held, n = held + len(written), n + 1          # headers count: empty pages fill an archive too
                if held >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()
    return run


def normalise(folder: str, level: int = LEVEL):
    """Over rows of archive names: each archive anew, a member per record, with its index."""
    def run(batches):
        fs, base = _file_system(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                new = f"{_name('records')}.warc.gz"
                n = at = 0
                with contextlib.ExitStack() as files:
                    src = files.enter_context(fs.open_input_stream(f"{base}/{name}", compression=None))
                    out = files.enter_context(fs.open_output_stream(f"{base}/{new}", compression=None))
                    index = files.enter_context(fs.open_output_stream(f"{base}/{new}.idx", compression=None))
                    for head, whole in records(inflate(src)):
                        z = zlib.compressobj(level, 8, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        index.write((json.dumps({"id": head["WARC-Record-ID"], "type": head["WARC-Type"],
                                                 "offset": at, "length": len(member)}) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n], pa.int64())], ["archive", "records"])
    return run


_BACK = "key string, page_json string, url string, payload_bytes bigint, payload_digest string, record_type string, " \
        "refers_key string"


def read_member(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and content of the record whose member lies there."""
    f.seek(offset)
    head, whole = next(records([zlib.decompress(f.read(length), 31)]))
    return head, whole[-int(head["Content-Length"]) - 4:-4]


def _read_back(folder: str):
    def run(batches):
        fs, base = _file_system(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    index = f.read().decode().splitlines()
                with fs.open_input_file(f"{base}/{name}") as f:
                    for line in index:
                        at = json.loads(line)
                        head, body = read_member(f, at["offset"], at["length"])
                        if head["WARC-Record-ID"] != at["id"]:
                            raise ValueError(f"{name}: the index names {at['id']}, there is {head['WARC-Record-ID']}")
                        payload = body.split(b"\r\n\r\n", 1)[1]
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        refers = head.get("WARC-Refers-To")
                        if refers is None and (hashlib.sha1(payload).hexdigest() != digest
                                               or len(payload) != int(head["X-Payload-Length"])):
                            raise ValueError(f"{name}: {at['id']} does not have its digest")
                        rows.append((at["id"][10:-1], head["X-Page-ID"], head["WARC-Target-URI"],
                                     int(head["X-Payload-Length"]), digest, at["type"], refers and refers[10:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64() if k == 3 else pa.string()) for k, c in enumerate(zip(*rows))],
                    [c.split()[0] for c in _BACK.split(", ")])
    return run


def _digests(batches):
    for b in batches:
        raw = [(h or "").encode() for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([hashlib.sha1(r).hexdigest() for r in raw]), pa.array([len(r) for r in raw], pa.int64())],
            [*b.schema.names, "digest", "size"])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the archives; (archive, records) of each."""
    prepare(pages.sparkSession)
    rows = located(pages, pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.mapInArrow(_digests, f"page_id {kind}, url string, html string, {FILE} string, {ROW} bigint, "
                                     "digest string, size bigint")
    key = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
                      F.lower(F.hex(F.xxhash64(FILE))), F.col(ROW).cast("string"))
    rows = rows.withColumn("key", key)
    # one row for each task and payload reaches the shuffle; the join leaves a hot payload to adaptive execution
    first = (rows.where(F.col("size") >= least).groupBy("digest", "size")
             .agg(F.max(F.struct("page_id", FILE, ROW, "key")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("digest", "size", F.col("first.key").alias("first")))
    dealt = rows.join(first, ["digest", "size"], "left").withColumn(
        "refers", F.when(F.col("first") != F.col("key"), F.col("first")))
    return dealt.select("page_id", "key", "url", "html", "digest", "refers").mapInArrow(
        _write_archives(folder, archive_bytes, level), "archive string, records bigint")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back: one row per record with page_id,
    payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or run_dir(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    written = save(write_archives(pages, folder, id_col, url_col, html_col, least, archive_bytes),
                   f"{folder}/written.parquet")
    # an archive a task: names are few and short
    parts = max(1, written.count())
    clean = save(written.repartition(parts).mapInArrow(normalise(folder), "archive string, records bigint"),
                 f"{folder}/normalised.parquet")
    back = clean.repartition(parts).mapInArrow(_read_back(folder), _BACK)
    page = F.from_json(F.concat(F.lit('{"p":'), F.col("page_json"), F.lit("}")), f"p {kind}")["p"]
    refers = F.regexp_extract("refers_key", "^(.*)-[0-9a-f]+-[0-9]+$", 1)
    return back.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.when(F.col("refers_key").isNotNull() & (refers != "null"), refers.cast(kind)).alias("refers_to"),
                       "url")
