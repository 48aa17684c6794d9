"""WARC archives: write captures, read records back, and join the records of each capture."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.session import settle, shared_folder

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
BLOCK = 1 << 20
MOST_TASKS = 20_000
MANIFEST = "path string, records bigint"
RECORDS = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "record_date string, http_status int, payload_digest string, payload_bytes bigint, "
    "digest_ok boolean, fields map<string,string>, payload binary"
)
ANSWERS = ("response", "revisit")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {' '.join(v.split())}" for k, v in headers.items() if v]
    lines.append(f"Content-Length: {len(block)}")
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def capture_records(file: str, number: int, capture: dict) -> bytes:
    """Request, response or revisit, and metadata of one capture, tied by concurrent-to ids."""
    payload = capture["payload"]
    uri = capture["url"] or ""
    name = urn(file, number, "answer")
    both = {"WARC-Target-URI": uri}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    answer = both | {
        "WARC-Record-ID": name,
        "WARC-Payload-Digest": "sha1:" + base32_sha1(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    if capture["refers_to"] is not None:
        answer["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        answer["WARC-Refers-To"] = urn("capture", capture["refers_to"])
        written = record("revisit", answer, head)
    else:
        written = record("response", answer, head + payload)
    request = both | {
        "WARC-Record-ID": urn(file, number, "request"),
        "WARC-Concurrent-To": name,
        "Content-Type": "application/http; msgtype=request",
    }
    metadata = {
        "WARC-Record-ID": urn(file, number, "metadata"),
        "WARC-Concurrent-To": name,
        "Content-Type": "application/warc-fields",
    }
    own = capture["capture_id"]
    fields = f"capture-id: {'' if own is None else own}\r\ncapture-urn: {urn('capture', own)}\r\n"
    return (
        record("request", request, b"GET / HTTP/1.1\r\n\r\n")
        + written
        + record("metadata", metadata, fields.encode())
    )


def write_archives(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``capture_id, url, payload, refers_to`` and return the manifest ``path, records``.

    A capture with ``refers_to`` becomes a revisit record without payload. Every task writes files
    of at most about 256 MB under names of its own into the shared folder; the settled manifest
    names the files of the task attempts that counted, so a lost executor leaves no double records.
    """
    spark = captures.sparkSession
    folder = folder or f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, path, number, size = None, "", 0, 0

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{path}"]), pa.array([3 * number])], names=["path", "records"]
            )

        for batch in batches:
            for start in range(0, len(batch), 64):
                for capture in batch.slice(start, 64).to_pylist():
                    if out is None:
                        path, number, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{path}", compression=None)
                    data = capture_records(path, number, capture)
                    out.write(data)
                    number, size = number + 1, size + len(data)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
                        yield listed()
        if out is not None:
            out.close()
            yield listed()

    columns = captures.select("capture_id", "url", "payload", "refers_to")
    return settle(columns.mapInArrow(run, MANIFEST))


def _members(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    unpack, held = zlib.decompressobj(31), bytearray()
    for data in stream:
        while data:
            held += unpack.decompress(data)
            data = b""
            if unpack.eof:
                yield bytes(held)
                data, unpack, held = unpack.unused_data, zlib.decompressobj(31), bytearray()
    if held:
        raise ValueError("the archive ends within a record")


def _blocks(source: pa.NativeFile) -> Iterator[bytes]:
    while data := source.read(BLOCK):
        yield data


def parse(member: bytes, with_payload: bool) -> dict:
    """One record; the payload's digest is computed from its bytes and held against the header."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
    block = rest[:length]
    kind = headers["warc-type"]
    status, payload, fields = None, None, {}
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest, ok = told, None
    if headers.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        first = http.split(b"\r\n", 1)[0].split()
        if kind in ANSWERS and len(first) > 1 and first[1].isdigit():
            status = int(first[1])
        if kind == "response":
            payload, digest = body, base32_sha1(body)
            ok = told is None or told == digest
    elif kind == "metadata":
        for line in block.decode("utf-8", "replace").split("\r\n"):
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip()] = value.strip()
    return {
        "record_id": headers.get("warc-record-id"),
        "record_type": kind,
        "concurrent_to": headers.get("warc-concurrent-to"),
        "refers_to": headers.get("warc-refers-to"),
        "target_uri": headers.get("warc-target-uri"),
        "record_date": headers.get("warc-date"),
        "http_status": status,
        "payload_digest": digest,
        "payload_bytes": None if payload is None else len(payload),
        "digest_ok": ok,
        "fields": list(fields.items()),
        "payload": payload if with_payload else None,
    }


ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "record_date")],
        ("http_status", pa.int32()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("digest_ok", pa.bool_()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the files in the manifest's ``path`` column, streamed file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(inner, compression=None) as source:
                    for member in _members(_blocks(source)):
                        rows.append(parse(member, with_payload))
                        size += len(member) if with_payload else 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    # A fixed number of tasks: paths are so short that adaptive execution would put them all in one.
    tasks = min(max(manifest.count(), 1), MOST_TASKS)
    return manifest.select("path").repartition(tasks).mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``record_id, answer, request, metadata`` as nested structs.

    Request and metadata records name their answer (response or revisit) as concurrent-to. An
    answer without either has nulls; with several, each request and metadata pair is a row, so
    nothing is gathered. Records that answer to nothing known, and other types, give no row.
    """
    columns = [c for c in records.columns if c not in ("record_id", "concurrent_to")]
    whole = F.struct("record_id", *columns)
    answers = records.where(F.col("record_type").isin(*ANSWERS)).select("record_id", whole.alias("answer"))

    def tied(kind: str) -> DataFrame:
        light = [c for c in columns if c in ("target_uri", "record_date", "fields")]
        return records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull()).select(
            F.col("concurrent_to").alias("record_id"),
            F.struct(F.col("record_id"), *light).alias(kind),
        )

    return answers.join(tied("request"), "record_id", "left").join(tied("metadata"), "record_id", "left")


def page_captures(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0
) -> DataFrame:
    """``capture_id, url, payload, refers_to`` of a page table.

    Of equal payloads of at least ``least`` bytes the smallest id is the response that the others
    refer to; null html is the empty payload. Rows that repeat an id and payload are all responses
    or all revisits; rows without id are responses.
    """
    rows = pages.select(
        F.col(id_col).alias("capture_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("_digest", F.sha2("payload", 256))
    ids = rows.where((F.length("payload") >= least) & F.col("capture_id").isNotNull()).select(
        "capture_id", "_digest"
    )
    first = ids.groupBy("_digest").agg(
        F.min("capture_id").alias("refers_to"), F.count(F.lit(1)).alias("n")
    )
    again = (
        ids.distinct()
        .join(first.where(F.col("n") > 1), "_digest")
        .where(F.col("capture_id") != F.col("refers_to"))
        .select("capture_id", "_digest", "refers_to")
    )
    return rows.join(again, ["capture_id", "_digest"], "left").drop("_digest")


def round_trip(pages: DataFrame, with_payload: bool = True, **columns) -> DataFrame:
    """Archive a page table, read it back and assemble it; revisits get the referred answer.

    Adds ``capture_id, refers_to_id, full_digest, full_bytes`` to the assembled rows.
    """
    captures = page_captures(pages, **columns)
    kind = captures.schema["capture_id"].dataType
    records = settle(read_archives(write_archives(captures), with_payload))
    rows = assemble(records).withColumn("_urn", F.col("metadata.fields")["capture-urn"])
    named = rows.withColumn("capture_id", F.expr("nullif(metadata.fields['capture-id'], '')").cast(kind))
    originals = (
        named.where(F.col("answer.record_type") == "response")
        .groupBy(F.col("_urn").alias("_of"))
        .agg(F.max(F.struct("capture_id", "answer.payload_bytes")).alias("_original"))
    )
    # Answers that refer to nothing carry their own id as key, which spreads them and meets nothing.
    key = F.coalesce("answer.refers_to", "record_id")
    joined = named.withColumn("_key", key).join(originals, F.col("_key") == F.col("_of"), "left")
    return joined.select(
        "capture_id",
        "answer",
        "request",
        "metadata",
        F.col("_original.capture_id").alias("refers_to_id"),
        F.col("answer.payload_digest").alias("full_digest"),
        F.coalesce("answer.payload_bytes", "_original.payload_bytes").alias("full_bytes"),
    )
