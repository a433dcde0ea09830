"""WARC archives with a two-level capture index.

Writing: each task writes gzip-per-record WARC files of bounded size into the shared folder through the URI's file
system (file, HDFS, S3 ...), under names of its own, and returns one capture row a record; rows of a failed attempt are
never seen. Of records with equal payloads of ``LEAST`` bytes or more, that with the largest page_id is a response and
the others are revisits of it.

Index: captures are range-sorted by reversed-host URL key (com,example,www)/path) and page_id; each range becomes an index
file of compressed blocks of ``LINES`` captures plus a sparse directory (first and last key, offset and length of each
block). A lookup bisects the index files' first keys (a list as long as there are index files), then one file's directory,
reads the one block range and bisects its lines; records are then read by their byte ranges, in file order.

Nulls and edges: null html is an empty payload; a null url has the empty key; a null page_id is archived like any other
and can neither be referred to nor refer by id; repeated rows with the largest page_id are responses each; an empty table
gives no rows and no files; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegrid.llm.common import partitions, salted_join, scratch, tune, written

LEAST, LINES, FILE_BYTES = 1000, 1000, 64 << 20
DATE = "2000-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, a closing bracket, path and query; no scheme, port 80/443 or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    port = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}:{digest}') if i is not None else uuid.uuid4()}>"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c if c > " " else f"%{ord(c):02X}" for c in url or ""), "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page_id is None else page_id, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to), "X-Refers-To-Page": refers_to}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of a record, its HTTP fields (lower-case names) and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(x.lower().split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def zipped(data: bytes) -> bytes:
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def put(base: str, rows: Iterator[tuple], suffix: str, roll: int) -> Iterator[tuple]:
    """Write (bytes, *rest) into files under ``base`` of about ``roll`` bytes; yields (file, offset, length, *rest)."""
    fs, path = pafs.FileSystem.from_uri(base)
    fs.create_dir(path, recursive=True)
    out, name, at = None, "", 0
    try:
        for data, *rest in rows:
            if out is None or at >= roll:
                if out:
                    out.close()
                name, at = f"{uuid.uuid4().hex}{suffix}", 0
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            out.write(data)
            yield (name, at, len(data), *rest)
            at += len(data)
    finally:
        if out:
            out.close()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def write_archives(pages: DataFrame, base: str, least: int = LEAST) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``base``; the captures (key, page_id, file, offset, length)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    several = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    marked = salted_join(rows, written(several.where("n > 1")), "digest", "page_id")
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")).alias("refers_to")
    schema = arrow(CAPTURES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((zipped(record(page, url, html, digest, refers)), url_key(url), page) for page, url, html, digest, refers in as_rows(batches))
        yield from batches_of(((key, page, *place) for *place, key, page in put(base, records, ".warc.gz", FILE_BYTES)), schema)

    return marked.select("page_id", "url", F.col("html").cast("binary"), "digest", refers).mapInArrow(write, CAPTURES)


def build_index(captures: DataFrame, base: str, lines: int = LINES) -> DataFrame:
    """Index files under ``base`` with their directories beside them; one row a file: file, first_key, last_key, blocks."""
    ordered = captures.repartitionByRange(partitions(captures), "key", "page_id").sortWithinPartitions("key", "page_id")
    schema = "file string, first_key string, last_key string, blocks long"
    rows_of = arrow(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            held: list[tuple] = []
            for row in as_rows(batches):
                held.append(row)
                if len(held) == lines:
                    yield zipped(json.dumps(held).encode()), held[0][0], held[-1][0]
                    held = []
            if held:
                yield zipped(json.dumps(held).encode()), held[0][0], held[-1][0]

        directory = list(put(base, blocks(), ".cdx.gz", 1 << 62))  # one file; a row for LINES captures
        if directory:
            fs, path = pafs.FileSystem.from_uri(base)
            file = directory[0][0]
            with fs.open_output_stream(f"{path}/{file}.dir", compression=None) as out:
                out.write(json.dumps([d[1:] for d in directory]).encode())
            yield from batches_of(iter([(file, directory[0][3], directory[-1][4], len(directory))]), rows_of)

    return ordered.mapInArrow(write, schema)


def lookup(keys: DataFrame, files: list[tuple[str, str, str]], base: str, tasks: int) -> DataFrame:
    """Captures of distinct ``keys`` (column key); files: (first_key, last_key, file) of the index, sorted."""
    lasts = [f[1] for f in files]
    requests, captures = arrow("shard int, key string"), arrow(CAPTURES)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            for (key,) in as_rows(batches):
                i = bisect_left(lasts, key)
                while i < len(files) and files[i][0] <= key:
                    yield i, key
                    i += 1

        yield from batches_of(pairs(), requests)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            fs, path = pafs.FileSystem.from_uri(base)
            shard, directory, source, at, block, names = -1, [], None, -1, [], []
            for i, key in as_rows(batches):
                if i != shard:
                    with fs.open_input_file(f"{path}/{files[i][2]}.dir") as f:
                        directory = json.loads(f.read())
                    source, shard, at = fs.open_input_file(f"{path}/{files[i][2]}"), i, -1
                b = bisect_left(directory, key, key=lambda d: d[3])  # the first block whose last key is not less
                while b < len(directory) and directory[b][2] <= key:
                    if b != at:
                        source.seek(directory[b][0])
                        block, at = json.loads(zlib.decompress(source.read(directory[b][1]), 31)), b
                        names = [c[0] for c in block]
                    j = bisect_left(names, key)
                    while j < len(names) and names[j] == key:
                        yield tuple(block[j])
                        j += 1
                    b += 1

        yield from batches_of(found(), captures)

    return keys.mapInArrow(route, "shard int, key string").repartition(tasks, "shard").sortWithinPartitions("shard", "key").mapInArrow(read, CAPTURES)


def fetch(captures: DataFrame, base: str, tasks: int) -> DataFrame:
    """The records at ``captures``, read by byte range in file order; payloads of responses are checked against their digests."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    rows_of = arrow(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            fs, path = pafs.FileSystem.from_uri(base)
            name, source = "", None
            for _, _, file, offset, length in as_rows(batches):
                if file != name:
                    name, source = file, fs.open_input_file(f"{path}/{file}")
                source.seek(offset)
                r = parsed(zlib.decompress(source.read(length), 31))
                f, digest = r["fields"], r["fields"]["WARC-Payload-Digest"].removeprefix("sha1:")
                if f["WARC-Type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                number = lambda k: int(f[k]) if f.get(k) else None  # noqa: B023, E731
                yield number("X-Page-ID"), int(r["http"]["content-length"]), digest, f["WARC-Type"], number("X-Refers-To-Page"), f["WARC-Target-URI"], r["payload"]

        yield from batches_of(records(), rows_of, 200)

    return captures.repartition(tasks, "file").sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as archives, index them, look every page's key up and read its records back."""
    tune(pages.sparkSession)
    base, tasks = scratch(pages.sparkSession), partitions(pages)
    captures = written(write_archives(pages, base, least))
    files = sorted((r["first_key"], r["last_key"], r["file"]) for r in written(build_index(captures, base)).collect())  # a row an index file
    return fetch(lookup(captures.select("key").distinct(), files, base, tasks), base, tasks)
