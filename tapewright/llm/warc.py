"""WARC archives and a two-level capture index.

Writing: each task writes one archive of gzip members, a record each, into a folder that all executors share. Of pages with
equal payloads of at least REVISIT_BYTES bytes the one with the largest page_id is the response and the others are revisits of
it. The name of an archive holds its task attempt; the manifest lists the archives of attempts that counted, so files of lost
attempts are never read.

Index: level one is sorted lines (reversed-host URL key, page_id, archive, offset, length), cut into blocks of BLOCK lines,
each compressed by itself; one file of blocks for each range of keys. Level two is a sparse directory: the first key of each
block with its offset and length, a small file beside each block file. A list with the first key of each file - one entry for
each task that wrote the index - is all that a driver holds.

Lookup: keys are dealt by range; a task finds the file, loads its directory, finds the blocks by binary search and emits a
row for each; then each block is read once, by a range read, and gives its matching lines; then each record is read by a range
read of its archive. A URL with very many captures is spread over many blocks.

Null html is an empty payload; null url has the empty key. Pages without page_id are kept (a null id is never the largest).
Rows with equal page_id and payload are all responses if that id is the largest. Payloads are the whole html in UTF-8.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import kept, table
from tapewright.sources.scratch import place

REVISIT_BYTES = 1000
BLOCK = 300
ARCHIVE_BYTES = 64 << 20  # of payload, about
_DATE = "2024-01-01T00:00:00Z"
_SAFE = re.compile(r"[\x00-\x20\x7f]")


def surt(url: str | None) -> str:
    """The key of a URL: host labels reversed, then port, path and query; lower case; no scheme, no `www`."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return _SAFE.sub(lambda m: f"%{ord(m[0]):02x}", (url or "").lower())
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return _SAFE.sub(lambda m: f"%{ord(m[0]):02x}", key.lower())


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(page: dict) -> bytes:
    """One WARC record: headers, the HTTP block, and the payload unless it is a revisit."""
    revisit = page["record_type"] == "revisit"
    payload = page["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {page['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(page['page_id']))}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_SAFE.sub(lambda m: f'%{ord(m[0]):02x}', page['url'] or '')}", f"WARC-Payload-Digest: sha1:{page['payload_digest']}", f"WARC-Page-ID: {'' if page['page_id'] is None else page['page_id']}",
        f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(page['refers_to']))}>", f"WARC-Refers-To-Page-ID: {page['refers_to']}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Headers of a record, and the payload of its HTTP block."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    fields["http-length"] = next(x.split(": ")[1] for x in http.decode().split("\r\n") if x.startswith("Content-Length"))
    return fields | {"payload": payload}


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to of each page."""
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    groups = base.where(F.length("payload") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("payload_digest").alias("d"), "largest")
    groups = kept(groups, "payload_groups")
    joined = base.join(groups, F.col("payload_digest") == F.col("d"), "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest")).alias("refers_to"))


_WRITTEN = "page_id bigint, key string, archive string, offset bigint, length bigint"


def _archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = {"page_id": [], "key": [], "archive": [], "offset": [], "length": []}
                for i in range(b.num_rows):
                    page = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(record(page)) + z.flush()
                    out.write(data)
                    for k, v in zip(rows, (page["page_id"], surt(page["url"]), name, at, len(data)), strict=True):
                        rows[k].append(v)
                    at += len(data)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(rows["page_id"], pa.int64()), pa.array(rows["key"]), pa.array(rows["archive"]), pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64())], list(rows))
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each page and returns the manifest: page_id, key, archive, offset, length."""
    return kept(decided(pages).mapInArrow(_archives(folder), _WRITTEN), "manifest")


def _index(folder: str):
    """Sorted manifest rows of a task -> one file of compressed blocks and its directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name, out, at, lines, directory = uuid.uuid4().hex, None, 0, [], []
        first = None

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
            out.write(data)
            directory.append([lines[0][0], at, len(data)])
            at, lines = at + len(data), []

        for b in batches:
            for page_id, key, archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out, first = system.open_output_stream(f"{root}/{name}.blocks", compression=None), key
                lines.append([key, page_id, archive, offset, length])
                if len(lines) == BLOCK:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with system.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
            f.write("\n".join(json.dumps(x, ensure_ascii=False) for x in directory).encode())
        yield pa.RecordBatch.from_pydict({"first": [first], "last": [key], "name": [name]})

    return run


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def build_index(manifest: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """(first key, last key, name) of each file of blocks, in order: an entry for each task."""
    dealt = manifest.repartitionByRange(_parts(manifest), "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")
    files = kept(dealt.select("page_id", "key", "archive", "offset", "length").mapInArrow(_index(folder), "first string, last string, name string"), "index_files")
    return sorted((r.first, r.last, r.name) for r in files.collect())


def _found(folder: str, files: list[tuple[str, str, str]]):
    """Keys -> the blocks that may hold them: binary search over files, then over the directory of each."""
    firsts, lasts = [f for f, _, _ in files], [x for _, x, _ in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        loaded: dict[str, tuple[list, list]] = {}
        for b in batches:
            out = {"key": [], "name": [], "offset": [], "length": []}
            for key in b.column(0).to_pylist():
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    name = files[i][2]
                    if name not in loaded:
                        if len(loaded) > 8:
                            loaded.clear()
                        with system.open_input_file(f"{root}/{name}.directory") as f:
                            entries = [json.loads(x) for x in f.read().decode().split("\n")]
                        loaded[name] = ([e[0] for e in entries], entries)
                    starts, entries = loaded[name]
                    for e in entries[max(0, bisect.bisect_left(starts, key) - 1) : bisect.bisect_right(starts, key)]:
                        for k, v in zip(out, (key, name, e[1], e[2]), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.string()), pa.array(out["name"], pa.string()), pa.array(out["offset"], pa.int64()), pa.array(out["length"], pa.int64())], list(out))

    return run


def _captures(folder: str):
    """key, name, offset, length, sorted by block -> the index lines of the keys; each block is read once in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        last, held = None, {}
        for b in batches:
            rows = []
            for key, name, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (name, offset) != last:
                    with system.open_input_file(f"{root}/{name}.blocks") as f:
                        f.seek(offset)
                        lines = [json.loads(x) for x in zlib.decompress(f.read(length)).decode().split("\n")]
                    last, held = (name, offset), {}
                    for x in lines:
                        held.setdefault(x[0], []).append(x)
                rows += held.get(key, [])
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], ["page_id", "key", "archive", "offset", "length"])

    return run


def lookup(keys: DataFrame, folder: str, files: list[tuple[str, str, str]]) -> DataFrame:
    """The captures of distinct URL keys (column 'key'): page_id, key, archive, offset, length."""
    n = _parts(keys)
    blocks = keys.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(_found(folder, files), "key string, name string, offset bigint, length bigint")
    return blocks.repartition(n, "name", "offset").sortWithinPartitions("name", "offset").mapInArrow(_captures(folder), _WRITTEN)


_READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name, source = None, None
        for b in batches:
            rows = []
            for archive, offset, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if archive != name:
                    name, source = archive, system.open_input_file(f"{root}/{archive}")
                source.seek(offset)
                x = parsed(zlib.decompress(source.read(length), 31))
                digest = x["WARC-Payload-Digest"].removeprefix("sha1:")
                if x["WARC-Type"] == "response" and hashlib.sha1(x["payload"]).hexdigest() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload is not the one that was written")
                page, refers = x["WARC-Page-ID"], x.get("WARC-Refers-To-Page-ID")
                rows.append((int(page) if page else None, x["WARC-Target-URI"], x["WARC-Type"], int(x["http-length"]), digest, int(refers) if refers else None, x["payload"]))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split(" ")[0] for x in _READ.split(", ")])

    return run


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures, by range reads; the captures of an archive are dealt out in parts of 4 MB."""
    dealt = captures.select("archive", "offset", "length").repartition(_parts(captures), F.col("archive"), F.expr("offset div 4194304")).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_records(folder), _READ)


QUERY = "op2_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives and their index, then looks up every URL key and reads the records back."""
    folder = place(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    files = build_index(manifest, f"{folder}/index")
    captures = lookup(manifest.select("key").distinct(), f"{folder}/index", files)
    return read_records(captures, folder).drop("payload", "url")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
