"""WARC archives: writing pages, reading records, assembling transactions.

Archives are ordinary `.warc.gz` files, one gzip member a record, in the shared folder. Each page
makes a request, a response (or a revisit of an equal earlier payload) and a metadata record, tied by
WARC-Concurrent-To. Reading gives one row a record; assembling joins the three through these
identifiers into one nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: a profile of the format
RECORD = (
    "record_id string, warc_type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "content_type string, payload_digest string, payload_bytes long, http_head string, fields map<string,string>, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}/{key}')}>"


def record(kind: str, ident: str, date: str, body: bytes, **more: str | None) -> bytes:
    """One gzip member: a record's header and block. more: further headers, `_` standing for `-`."""
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date} | {k.replace("_", "-"): v for k, v in more.items() if v is not None} | {"Content-Length": str(len(body))}
    data = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + data.encode() + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def _one_line(url: str | None) -> str:
    """A URL as a header can hold it: white space, controls and what isn't ASCII are percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


#: Equal rows that are written by one task.
REPEATS = 256


def _keyed(pages: DataFrame) -> DataFrame:
    """pages with every row's place in its group of equal payloads: (page_id, url, html, first_id, first_url, copy).

    first_id and first_url name the response of a payload that several rows share (null: no other has
    it), copy counts rows that are equal in everything. Payload groups are found over ids and hashes
    alone; html moves once, by all of (page_id, url, hash), so that neither a common payload nor a
    common id gathers it.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    keys = own.groupBy("page_id", "url", "sha").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")  # null ids come last
    first = keys.groupBy("sha").agg(F.min(order).alias("first"), F.sum("n").alias("all")).where("all > 1").drop("all")
    shared = keys.join(first, "sha").select("page_id", "url", "sha", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("shared"))
    shared = written(shared, "shared-payloads")
    same = lambda a, b: a["sha"].eqNullSafe(b["sha"]) & a["page_id"].eqNullSafe(b["page_id"]) & a["url"].eqNullSafe(b["url"])
    columns = ["page_id", "url", "html", "first_id", "first_url", "shared"]
    marked = own.join(shared, same(own, shared), "left").where(F.coalesce(shared["n"], F.lit(1)) == 1)
    out = marked.select(own["page_id"], own["url"], "html", "first_id", "first_url", "shared", F.lit(0).cast("long").alias("copy"))
    if not shared.where("n > 1").isEmpty():  # rows equal in everything become one with their number, and that many again
        many = shared.where("n > 1")
        one = own.join(many, same(own, many)).groupBy(own["page_id"], own["url"], own["sha"], "n", "first_id", "first_url", "shared").agg(F.first("html").alias("html"))
        parts = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS))))
        parts = parts.repartition("page_id", "url", "sha", "part")
        copy = F.sequence(F.col("part") * REPEATS, F.least(F.col("n"), (F.col("part") + 1) * REPEATS) - 1)
        out = out.unionByName(parts.select(*columns, F.explode(copy).alias("copy")))
    return out


def write_archives(pages: DataFrame, spark: SparkSession, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages(page_id, url, html) to archives in a new shared folder; returns the manifest (path, records, bytes).

    Every row is a capture of its own, whose record id comes from its page_id, url, payload and, for rows
    equal in all of these, its number. Of rows with equal payloads those with the smallest page_id are
    responses and the others revisit the first of them; null ids count as larger than all others, and a
    row without an id has no page-id field. Files of attempts that failed stay out of the manifest.
    """
    folder = fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, n, size, manifest = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, first_id, first_url, shared, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                    out.write(record("warcinfo", record_id("info", path), date, b"software: lodestack\r\nformat: WARC File Format 1.1\r\n", Content_Type="application/warc-fields"))
                body, uri = html.encode("utf-8"), _one_line(url)
                again = bool(shared) and first_id != page_id
                name = base32_sha1(body)
                key = _capture(page_id, url, name, copy)
                main, digest = record_id("capture", key), f"sha1:{name}"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                ask = f"GET {uri} HTTP/1.1\r\n\r\n".encode()
                fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
                for data in (
                    record("request", record_id("request", key), date, ask, WARC_Target_URI=uri, WARC_Concurrent_To=main, Content_Type="application/http; msgtype=request"),
                    record("revisit" if again else "response", main, date, head if again else head + body, WARC_Target_URI=uri, WARC_Payload_Digest=digest, WARC_Refers_To=record_id("capture", _capture(first_id, first_url, name, 0)) if again else None, WARC_Profile=REVISIT if again else None, Content_Type="application/http; msgtype=response"),
                    record("metadata", record_id("metadata", key), date, fields, WARC_Target_URI=uri, WARC_Concurrent_To=main, Content_Type="application/warc-fields"),
                ):
                    out.write(data)
                n, size = n + 3, size + len(head) + len(body)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    manifest.append((f"{folder}/{path}", n, size))
                    out = None
        if out is not None:
            out.close()
            manifest.append((f"{folder}/{path}", n, size))
        if manifest:
            paths, ns, sizes = zip(*manifest)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return written(_keyed(pages).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def _capture(page_id, url: str | None, digest: str, copy: int) -> str:
    return json.dumps([page_id, url, digest, copy])


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one at a time; raises if the last is cut short."""
    rest, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(unpack.decompress(data))
        rest = b""
        if unpack.eof:
            yield b"".join(parts)
            rest, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


def parse(data: bytes, with_payload: bool) -> tuple:
    """A record's bytes -> a row of RECORD. A response's digest and length are of what was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    h = _headers(lines)
    block = rest[: int(h["content-length"])]
    kind, digest, n, http, fields, payload = h.get("warc-type"), h.get("warc-payload-digest"), None, None, None, None
    if "application/http" in h.get("content-type", ""):
        http, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest, n, payload = f"sha1:{base32_sha1(body)}", len(body), body if with_payload else None
        elif kind == "revisit" and (length := _headers(http).get("content-length", "")).isdigit():
            n = int(length)
        http = http.decode("utf-8", "replace")
    elif h.get("content-type") == "application/warc-fields":
        fields = list(_headers(block).items())
    return h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("content-type"), digest, n, http, fields, payload


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row a record of the archives in manifest(path); with_payload=False leaves payloads out, not their digests."""
    kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data, with_payload))
                        size += len(data) if with_payload else 500
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("path").repartition(tasks).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, warc_type, target_uri, date, payload_digest, payload_bytes, refers_to, response, request, metadata).

    Requests and metadata find their capture through concurrent_to; a capture without one has a null
    there. Of several for one capture, that with the smallest record id is taken. Records read twice count once.
    """
    records = written(records, "records")
    main = records.where("warc_type in ('response', 'revisit')").dropDuplicates(["record_id"])

    def beside(kind: str, value: F.Column) -> DataFrame:
        return records.where(F.col("warc_type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(value, "record_id").alias(kind))

    request = beside("request", F.struct("record_id", "http_head"))
    metadata = beside("metadata", F.struct("record_id", "fields"))
    return (
        main.join(request, "record_id", "left").join(metadata, "record_id", "left")
        .select(F.col("record_id").alias("capture_id"), "warc_type", "target_uri", "date", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
                "payload_bytes", "refers_to", F.struct("http_head", "payload").alias("response"), "request", "metadata")
    )


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives written from pages and read back.

    One row for each row of pages, repeated ids and repeated rows included. A null html is an empty
    payload, a null page_id stays null and refers_to is never null in a revisit but where the response
    has no id either. An empty table gives none.
    """
    kind = pages.schema["page_id"].dataType
    got = assemble(read_archives(write_archives(pages, spark), with_payload=False))
    page = F.col("metadata.fields")["page-id"].try_cast(kind)
    got = got.select("capture_id", page.alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to").alias("ref"))
    got = written(got, "captures")
    target = got.where("record_type = 'response'").select(F.col("capture_id").alias("ref"), F.col("page_id").alias("refers_to"))
    # few payloads are referred to, though by many: only those are looked up
    used = target.join(got.where("ref is not null").select("ref").distinct(), "ref")
    return got.join(used, "ref", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
