"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing: a first scan takes the payloads' digests, and rows whose payload another row has too are decided on as narrow rows; in a
second scan each task writes its pages as .warc.gz files (a gzip member a record) of about `FILE_BYTES` to a shared
folder, each under a temporary name first and renamed when whole, so a repeated or lost task leaves
no half file; a manifest written as Parquet names the files that count, with their numbers of records. A payload goes into an
HTTP response with chunked transfer framing; content blocks over `SEGMENT_BYTES` are cut into
segments (a first record and `continuation` records with the origin's id, their segment numbers and, on
the last, the total length). A payload of `DEDUP_BYTES` or more that another page of larger page_id
has too becomes a `revisit` that refers to that page's response. Pages are never shuffled.

Reading: files are dealt out to tasks and parsed record by record; whole records are decoded in
place, only segments are shuffled. These are grouped by origin id and split by the origin's hash, put in order by segment
number, checked against the total length, joined, and their chunked framing is decoded. Revisits
get the full payload's length and page_id from the response that they name.

Defined cases: a null html is an empty payload; null urls give the target URI "urn:none"; the response of equal
payloads is the row with the largest page_id (null lowest), of several with it the last in the table, so there is one response whatever rows
are repeated; repeated rows are records of their own. A null page_id stays null, ids of any type keep it. An empty table gives no files and no rows. Missing, repeated or
inconsistent segments, files with other numbers of records than the manifest says, payloads without the digest that
they declare and revisits without their response raise an error that names the record. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm import common as C

DEDUP_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK = 4096
FILE_BYTES = 32 << 20
DATE = "2026-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def encode_chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def decode_chunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        part = body[at : at + size]
        if len(part) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunked framing")
        out.append(part)
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer framing taken off."""
    head, _, body = block.partition(_END)
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return decode_chunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + _END


def response_records(record_id: str, fields: list[tuple[str, str]], block: bytes, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """One response record, or its segments."""
    if len(block) <= segment:
        yield record("response", record_id, [*fields, ("Content-Type", "application/http;msgtype=response")], block)
        return
    n = -(-len(block) // segment)
    for i in range(n):
        part = block[i * segment : (i + 1) * segment]
        if i == 0:
            yield record("response", record_id, [*fields, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", "1")], part)
            continue
        total = [("WARC-Segment-Total-Length", str(len(block)))] if i == n - 1 else []
        uri = [x for x in fields if x[0] == "WARC-Target-URI"]
        yield record("continuation", f"{record_id}:{i + 1}", [*uri, ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(i + 1)), *total], part)


class Store:
    """Files below a shared folder, through the file system its address names."""

    def __init__(self, address: str):
        self.fs, self.path = pafs.FileSystem.from_uri(address)

    def put(self, name: str, data: bytes) -> None:
        self.fs.create_dir(self.path, recursive=True)
        hidden = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(hidden) as f:
            f.write(data)
        self.fs.move(hidden, f"{self.path}/{name}")

    def records(self, name: str, step: int = 1 << 20) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        """Headers and blocks of a file's records, read as a stream."""
        with self.fs.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            unzip, data = zlib.decompressobj(31), b""
            while True:
                raw = unzip.unused_data if unzip.eof else b""
                if unzip.eof:
                    unzip = zlib.decompressobj(31)
                raw = raw or f.read(step)
                if not raw:
                    break
                data += unzip.decompress(raw)
                at = 0
                while (end := data.find(_END, at)) >= 0:
                    lines = data[at:end].split(b"\r\n")
                    if not lines[0].startswith(b"WARC/"):
                        raise ValueError(f"{name}: a record doesn't start with its version")
                    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
                    last = end + 4 + int(head[b"content-length"])
                    if len(data) < last + 4:
                        break
                    yield head, data[end + 4 : last]
                    at = last + 4
                data = data[at:]
            if data or not unzip.eof and unzip.unconsumed_tail:
                raise ValueError(f"{name} ends within a record")


def _revisits(pages: DataFrame, scans: C.Scans) -> C.Sides:
    """For each partition of a stable table its rows (place) whose payload another row has too, and the response that they revisit (its row)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        part, row = C.partition_id(), 0
        for batch in scans.check(batches, 0, 2, first=True):
            data, offsets = C.flat_text(batch.column(2))
            long = np.flatnonzero(np.diff(offsets) >= DEDUP_BYTES)
            raw = memoryview(data)
            digests = [hashlib.sha1(raw[offsets[i] : offsets[i + 1]]).digest() for i in long]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).take(pa.array(long)), pa.array((np.int64(part) << C.Sides.ROW_BITS) + row + long)], names=["digest", "page_id", "row"])
            row += len(batch)

    rows = C.written(C.mapped(pages, run, f"digest binary, page_id {kind}, row long"), "warc-payloads")
    # counts of copies shrink within each task before they meet; only payloads with several rows are joined back
    best = rows.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count("*").alias("copies")).where("copies > 1")
    best = C.written(best.select("digest", F.col("best.row").alias("response")), "warc-responses")
    sides = C.Sides(pages.sparkSession, "warc-revisits")
    place = F.col("row").bitwiseAND(F.lit((1 << C.Sides.ROW_BITS) - 1)).alias("place")
    sides.write(rows.join(best, "digest").where("row <> response").select(F.shiftright("row", C.Sides.ROW_BITS).cast("int").alias("part"), place, "response"))
    C.drop(rows, best)
    return sides


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages (page_id, url, html) as archives; returns the manifest (file, records)."""
    pages, scans = C.stable(pages.select("page_id", "url", "html")), C.Scans(pages.sparkSession, "scans")
    sides = _revisits(pages, scans)

    def run(batches):
        store, parts, size, n = Store(folder), [], 0, 0
        done, part, first = [], C.partition_id(), 0
        run_id = uuid.uuid4().hex
        side = sides.read(part, ["place", "response"])
        again = dict(zip(*(x.tolist() for x in side))) if side is not None else {}

        def flush():
            nonlocal parts, size, n
            if parts:
                name = f"part-{run_id}-{len(done):05d}.warc.gz"
                store.put(name, b"".join(parts))
                done.append((name, n))
            parts, size, n = [], 0, 0

        for batch in scans.check(batches, 0, 2):
            for i, (page, url, html) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                payload = (html or "").encode()
                row = (part << C.Sides.ROW_BITS) + first + i
                fields = [("WARC-Target-URI", (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}")]
                if page is not None:
                    fields.append(("X-Page-Id", quote(str(page), safe="")))
                if (response := again.get(first + i)) is not None:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:row:{response}>")]
                    out = [record("revisit", f"urn:row:{row}", fields, b"")]
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + encode_chunked(payload)
                    out = list(response_records(f"urn:row:{row}", fields, block))
                for x in out:
                    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
                    parts += [zipped.compress(x) + zipped.flush()]
                    size += len(parts[-1])
                    n += 1
                if size >= FILE_BYTES:
                    flush()
            first += len(batch)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["file", "records"])

    manifest = C.written(C.mapped(pages, run, "file string, records long"), "warc-manifest")
    sides.drop(pages.sparkSession)
    return manifest


_OUT = "page_id string, payload_bytes long, payload_digest string, declared string, record_type string, refers_to string, record string, origin string, segment long, total long, part binary"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _resolved(page: str, payload: bytes, declared: str, record_id: str) -> tuple:
    digest = hashlib.sha1(payload).hexdigest()
    if declared != f"sha1:{digest}":
        raise ValueError(f"record {record_id}: its payload doesn't have the digest it declares")
    return page, len(payload), digest, declared, "response", None, record_id, None, None, None, None


def read(spark: SparkSession, manifest: DataFrame, folder: str, kind: str = "string") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record; kind is the type of page ids."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names=_NAMES)

    def run(batches):
        store = Store(folder)
        for batch in batches:
            for name, expected in zip(*(batch.column(k).to_pylist() for k in range(2))):
                rows, size, n = [], 0, 0
                for head, block in store.records(name):
                    n += 1
                    get = lambda k: head[k].decode() if k in head else None  # noqa: E731, B023
                    record_id, kind = get(b"warc-record-id"), get(b"warc-type")
                    if kind == "continuation" or b"warc-segment-number" in head:
                        origin = get(b"warc-segment-origin-id") or record_id
                        total = get(b"warc-segment-total-length")
                        rows.append((get(b"x-page-id"), None, None, get(b"warc-payload-digest"), "segment", None, record_id, origin, int(get(b"warc-segment-number")), int(total) if total else None, block))
                    elif kind == "revisit":
                        declared = get(b"warc-payload-digest")
                        rows.append((get(b"x-page-id"), None, declared.removeprefix("sha1:"), declared, "revisit", get(b"warc-refers-to"), record_id, None, None, None, None))
                    elif kind == "response":
                        rows.append(_resolved(get(b"x-page-id"), http_payload(block), get(b"warc-payload-digest"), record_id))
                    size += len(block)
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{name} holds {n} records, not {expected}")
                yield table(rows)

    # rows must lie in the shared folder before they are read twice: files are parsed once
    rows = C.written(manifest.select("file", "records").repartition(C.tasks(spark)).mapInArrow(C.trimmed(run), _OUT), "warc-records")

    def join(batches):
        for batch in batches:
            out = []
            for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.sort(key=lambda x: x["segment"])
                totals = [x["total"] for x in parts if x["total"] is not None]
                block = b"".join(x["part"] for x in parts)
                if [x["segment"] for x in parts] != list(range(1, len(parts) + 1)) or totals != [len(block)]:
                    raise ValueError(f"segments of {origin}: numbers {[x['segment'] for x in parts]}, total {totals}, {len(block)} bytes found")
                out.append(_resolved(parts[0]["page_id"], http_payload(block), parts[0]["declared"], origin))
            yield table(out)

    # a group is the segments of one record, and so as large as one page
    segments = rows.where("record_type = 'segment'").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "part", "page_id", "declared")).alias("parts"))
    joined = C.written(C.mapped(segments, join, _OUT), "warc-joined")
    responses = rows.where("record_type = 'response'").unionByName(joined)
    # a revisit names its response, which must be there and have the payload that the revisit declares
    known = responses.select(F.col("record").alias("refers_to"), F.col("payload_bytes").alias("full"), F.col("payload_digest").alias("true"), F.col("page_id").alias("response"))
    revisits = rows.where("record_type = 'revisit'").join(known, "refers_to", "left")
    lost = F.raise_error(F.concat(F.lit("revisit "), F.col("record"), F.lit(": its response "), F.coalesce("refers_to", F.lit("none")), F.lit(" isn't there or has another payload"))).cast("long")
    revisits = revisits.withColumn("payload_bytes", F.when(F.col("true") == F.col("payload_digest"), F.col("full")).otherwise(lost)).withColumn("refers_to", F.col("response")).drop("full", "true", "response")
    ids = [F.url_decode(c).cast(kind).alias(c) for c in ("page_id", "refers_to")]
    return responses.unionByName(revisits).select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = C.shared_dir(spark, "warc"), C.read_table(spark, sf_dir, "pages")
    return read(spark, write(pages, folder), folder, pages.schema["page_id"].dataType.simpleString())


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS nth, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN best END AS refers_to
FROM b
"""
