"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write`` makes one archive a task, deliberately as a single gzip stream over the whole file, as many
crawlers leave them. ``normalise`` inflates such a stream once, front to back, rewrites every record
as a gzip member of its own, and writes a sidecar index of offsets (one JSON line a record). ``read``
uses the index to read members one by one.

Records with equal payloads: the one with the largest page_id is a response, all others are revisits
that refer to it and repeat neither payload nor body.

Cases: a null html is an empty payload; empty payloads are equal to each other. A null url is written
without a target. A page whose page_id is null never becomes the response of others; where all are
null, all are responses. Rows that repeat the largest page_id with the same payload are responses, each.
An empty table gives no archive and no rows. Control characters in urls are percent-encoded. Other
columns are ignored. A task that is run again writes new files under new names; only those of the
attempt that ended well are in the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, maybe_in, new_path, table

GZIP, LEVEL, CHUNK = 31, 6, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A WARC record of an HTTP response, or of a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def inflated(source):
    """Pieces of the data in a gzip stream of one or more members."""
    z = zlib.decompressobj(GZIP)
    while raw := source.read(CHUNK):
        while raw:
            if out := z.decompress(raw):
                yield out
            raw = z.unused_data
            if z.eof:
                z = zlib.decompressobj(GZIP)
            else:
                break


def records(pieces):
    """(head, whole record) of each record in a stream of pieces."""
    buffer = bytearray()
    need, head = 0, b""
    for piece in pieces:
        buffer += piece
        at = 0
        while True:
            if not need:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = bytes(buffer[at:end])
                need = end - at + 4 + int(fields(head)["Content-Length"]) + 4
            if len(buffer) - at < need:
                break
            yield head, bytes(buffer[at : at + need])
            at, need = at + need, 0
        del buffer[:at]
    if buffer:
        raise ValueError("the archive ends inside a record")


def write(pages: DataFrame) -> DataFrame:
    """Archives of all pages, each a single gzip stream; the manifest: path, n_records."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc-whole")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(F.encode(payload, "utf-8")).alias("digest"))
    # Only payloads that occur more than once; as a table, so that the planner sees its real size and
    # broadcasts it only if it is small.
    again = table(spark, rows.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1 and keep is not null").select("digest", "keep"), "warc-again")
    # Pages whose payload occurs once never leave their task, however many others there are.
    rows = rows.withColumn("h", F.xxhash64("digest"))
    ids = again.select(F.xxhash64("digest").alias("h"))
    met = maybe_in(rows, "h", ids).join(again, "digest", "left")
    rows = met.unionByName(maybe_in(rows, "h", ids, among=False).withColumn("keep", F.lit(None).cast("long")))
    rows = rows.select("page_id", "url", F.encode("payload", "utf-8").alias("payload"), "digest", "keep")

    def make(batches):
        fs, root = FileSystem.from_uri(folder)
        out, n = None, 0
        for b in batches:
            for page_id, url, body, digest, keep in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, z = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=GZIP)
                sha = base64.b32encode(bytes.fromhex(digest)).decode()
                out.write(z.compress(record(page_id, url, body, sha, None if keep is None or keep == page_id else keep)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return table(spark, rows.mapInArrow(lean(make), "path string, n_records long"), "warc-manifest")


def normalise(manifest: DataFrame, keep_whole: bool = False) -> DataFrame:
    """Rewrites each archive of the manifest; path, index, n_records of the new ones.

    The whole-file archives go once all are rewritten, unless keep_whole is set.
    """
    spark = manifest.sparkSession
    folder = new_path(spark, "warc-members")

    def make(batches):
        fs, root = FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                fs.create_dir(root, recursive=True)
                name = uuid.uuid4().hex
                source_fs, source = FileSystem.from_uri(path)
                at, n = 0, 0
                with source_fs.open_input_stream(source, compression=None) as f, fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    for head, whole in records(inflated(f)):
                        z = zlib.compressobj(LEVEL, wbits=GZIP)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        h = fields(head)
                        index.write((json.dumps({"offset": at, "length": len(member), "id": h["WARC-Record-ID"], "type": h["WARC-Type"], "url": h.get("WARC-Target-URI"), "digest": h.get("WARC-Payload-Digest")}) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([f"{folder}/{name}.idx"]), pa.array([n], pa.int64())], names=["path", "index", "n_records"])

    files = max(1, manifest.count())
    done = table(spark, manifest.select("path").repartition(files).mapInArrow(lean(make), "path string, index string, n_records long"), "warc-index")
    if not keep_whole:
        from .shared import drop_path

        for r in manifest.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().limit(2).collect():  # one folder holds them all
            drop_path(spark, r[0])
    return done


def member(source, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and body of the record at an offset."""
    source.seek(offset)
    whole = zlib.decompress(source.read(length), GZIP)
    head, _, rest = whole.partition(b"\r\n\r\n")
    h = fields(head)
    http, _, body = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")
    return h, fields(http), body


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, by offset."""

    def number(uri):
        x = uri.rpartition(":")[2].rstrip(">") if uri else ""
        return None if x in ("", "None") else int(x)

    def make(batches):
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, p = FileSystem.from_uri(path)
                with fs.open_input_stream(FileSystem.from_uri(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                out = []
                with fs.open_input_file(p) as f:
                    for e in entries:
                        h, http, body = member(f, e["offset"], e["length"])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and (len(body) != int(http["Content-Length"]) or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                            raise ValueError(f"{path}: the payload of {h['WARC-Record-ID']} is damaged")
                        out.append((number(h["WARC-Record-ID"]), int(http["Content-Length"]), digest, h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("path", "index").repartition(max(1, archives.count())).mapInArrow(lean(make), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    return read(normalise(write(pages)))
