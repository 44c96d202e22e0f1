"""Deterministic sharded WARC writer and its reader.

Records are range-partitioned and sorted by page id, written one gzip member each
to files that roll at a compressed size, and regenerate all headers, ids and
digests from the rows. Of equal payloads one record is a response and the others
are revisits that refer to it. A file is written under a temporary name and moved
to its own when complete; the manifest, written last, lists the files that count.
Names and bytes depend on the rows alone, so that a task that runs twice leaves
the same files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import lean, materialize, shared_dir, small_batches

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, first_page long, last_page long, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page: int | None, sha1_hex: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}:{sha1_hex}')}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def one_line(x: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in x.encode())


def page_record(page: int | None, url: str | None, sha1_hex: str, payload: bytes, refers: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page, sha1_hex)), ("WARC-Date", date), ("WARC-Target-URI", one_line(url or "")), ("WARC-Payload-Digest", f"sha1:{base32(sha1_hex)}"), ("Content-Type", "application/http;msgtype=response")]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if refers is None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, sha1_hex)), ("X-Refers-To-Page", str(refers))]
    return record("revisit", fields, http)


def _writer(uri: str, roll_bytes: int, level: int, date: str):
    @lean
    def run(batches):
        files, folder = store(uri)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        done: list[tuple] = []
        out, seq, size, n, first, last, whole = None, 0, 0, 0, None, None, None

        def put(data: bytes) -> int:
            press = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = press.compress(data) + press.flush()
            out.write(member)
            whole.update(member)
            return len(member)

        def close():
            nonlocal out, seq
            out.close()
            files.move(temporary, f"{folder}/{name}")
            done.append((name, first, last, n, size, whole.hexdigest()))
            out, seq = None, seq + 1

        refers: dict[tuple, int] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                chunk = batch.slice(low, 64)
                for page, sha1_hex, role, response, url, payload in zip(*(chunk.column(k).to_pylist() for k in range(6)), strict=True):
                    if role == 0:  # the revisit mark comes just before its page
                        refers = {(page, sha1_hex): response}
                        continue
                    if out is None:
                        name = f"part-{part:05d}-{seq:05d}.warc.gz"
                        temporary = f"{folder}/_temporary/{name}.{attempt}"
                        out, whole, n, size, first = files.open_output_stream(temporary), hashlib.sha256(), 0, 0, page
                        info = f"software: sharded writer\r\nformat: WARC File Format 1.1\r\npart: {part}-{seq}\r\n".encode()
                        size += put(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
                    size += put(page_record(page, url, sha1_hex, payload or b"", refers.get((page, sha1_hex)), date))
                    n, last = n + 1, page
                    if size >= roll_bytes:
                        close()
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "first_page", "last_page", "records", "bytes", "sha256"), x, strict=True)) for x in done], schema=MANIFEST_ARROW)
                done = []
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "first_page", "last_page", "records", "bytes", "sha256"), x, strict=True)) for x in done], schema=MANIFEST_ARROW)

    return run


MANIFEST_ARROW = pa.schema([("file", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def write(pages: DataFrame, uri: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", parts: int | None = None, roll_bytes: int = 64 << 20, least_bytes: int = 0, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write a record for every row of pages below uri and return uri.

    Of rows with equal payloads of least_bytes or more, that with the largest
    page_id is the response and the others revisit it; smaller ones are responses.
    Rows that repeat that page_id and payload are responses too. A null payload is
    empty; a null page_id sorts first, is a response and has no X-Page-Id; a null
    url is empty. No rows give no files and an empty manifest. Other columns are ignored.

    uri: a folder that all executors reach, by default one in the shared folder;
    any scheme that pyarrow.fs opens will do.
    """
    spark = pages.sparkSession
    small_batches(spark)
    uri = uri or f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.sha1(payload).alias("sha"), F.lit(1).alias("role"), F.lit(None).cast("long").alias("response"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keys = pages.where(F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))) >= least_bytes).select(F.col(id_col).cast("long").alias("page"), F.sha1(payload).alias("sha"))
    same = materialize(keys.groupBy("sha").agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "response"), "equal-payloads")
    marks = keys.join(same, "sha").where("page <> response").select("page", "sha", F.lit(0).alias("role"), "response", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.union(marks).repartitionByRange(parts, "page").sortWithinPartitions("page", "sha", "role")
    files, folder = store(uri)
    files.create_dir(f"{folder}/_temporary", recursive=True)
    written = materialize(dealt.mapInArrow(_writer(uri, roll_bytes, level, date), MANIFEST), "warc-parts")
    with files.open_output_stream(f"{folder}/_temporary/manifest.jsonl") as out:
        for row in written.orderBy("file").toLocalIterator():
            out.write((json.dumps(row.asDict(), sort_keys=True) + "\n").encode())
    files.move(f"{folder}/_temporary/manifest.jsonl", f"{folder}/manifest.jsonl")
    files.delete_dir(f"{folder}/_temporary")
    return uri


def members(stream):
    """Decompressed gzip members of a binary stream."""
    data, press, out = b"", zlib.decompressobj(31), []
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            break
        out.append(press.decompress(data))
        data = press.unused_data
        if press.eof:
            yield b"".join(out)
            press, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("a gzip member is cut short")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    return fields, block


def _reader(uri: str, with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    @lean
    def run(batches):
        files, folder = store(uri)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with files.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        fields, block = parse(raw)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        seen += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
                        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                        rows.append({"page_id": page and int(page), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers), "payload": payload if with_payload and kind == "response" else None})
                        held += len(payload) if with_payload else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, its manifest {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read(spark, uri: str, *, with_payload: bool = True) -> DataFrame:
    """Records of the files that the manifest lists, digests verified; revisits have a null payload."""
    files, folder = store(uri)
    with files.open_input_stream(f"{folder}/manifest.jsonl") as stream:
        listed = [json.loads(x) for x in stream.read().splitlines()]
    names = spark.createDataFrame([(x["file"], x["records"]) for x in listed], "file string, records long")
    return names.repartition(max(1, len(listed)), "file").mapInArrow(_reader(uri, with_payload), RECORD)
