"""WARC archives as a chunked record table.

Payloads travel as rows (record, chunk number, bytes), never as whole records: a payload is walked once into a table of
chunks, each with the digests of the payload so far; the writer streams the chunks of a record into an archive, the reader
streams an archive into chunks, each with the digest so far again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import join_counted, materialise, meet_by_number, open_folder, scratch

#: Bytes in a chunk, and bytes of chunks in a batch of rows.
CHUNK, HELD = 1 << 18, 1 << 23
#: Bytes of payload, of records of several chunks, that a writing task gets, on average at most.
TASK_BYTES = 1 << 26
#: Records of several chunks that a writing task gets, on average at most.
TASK_RECORDS = 4000
#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Reading tasks at most; with more archives, each reads several.
TASKS = 20_000
CRLF = b"\r\n"


def record_id(number: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{number}')}>"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _head(row: dict) -> bytes:
    """WARC and HTTP headers of a record; a revisit's block ends after the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    size = len(http) + (row["bytes"] if row["type"] == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: {record_id(row['id'])}", "WARC-Date: 1970-01-01T00:00:00Z"]
    target = quote(row["url"] or "", safe=":/?#[]@!$&()*+,;=%~'")
    lines += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}"]
    lines += [f"X-Url: {json.dumps(row['url'])}"] if target != row["url"] else []  # null, or not as a header may hold it
    lines += [f"X-Record-Number: {row['id']}"] if row["id"] is not None else []
    if row["type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'])}"]
        lines += [f"X-Refers-To-Number: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + http


CHUNKS = "rid long, id long, url string, chunk int, data binary, bytes long, sha1 string, sha256 string, last boolean"
CHUNK_FIELDS = [("rid", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("bytes", pa.int64()), ("sha1", pa.string()), ("sha256", pa.string()), ("last", pa.bool_())]


def chunks(pages: DataFrame, id_col: str, url_col: str, payload_col: str, size: int = CHUNK) -> DataFrame:
    """The chunked record table of pages: rid (a number for each row), id, url, chunk number, data, and bytes, SHA-1 and
    SHA-256 (hex) of the payload so far; the last chunk of a record is marked. An empty payload is one empty chunk.

    A payload is walked once, in slices of its Arrow buffer; no more than HELD bytes and a chunk are copied at a time.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), CHUNK_FIELDS, strict=True)], [n for n, _ in CHUNK_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                rid, number, url = (batch.column(k)[i].as_py() for k in range(3))
                view = memoryview(batch.column(3)[i].as_buffer() or b"")
                one, two = hashlib.sha1(), hashlib.sha256()
                for k in range(max(1, -(-len(view) // size))):
                    data = view[k * size : (k + 1) * size]
                    one.update(data)
                    two.update(data)
                    seen = min(len(view), (k + 1) * size)
                    out.append((rid, number, url if k == 0 else None, k, bytes(data), seen, one.hexdigest(), two.hexdigest(), seen == len(view)))
                    held += len(data)
                    if held >= HELD or len(out) >= 2000:
                        yield table(out)
                        out, held = [], 0
            if out:
                yield table(out)

    return rows.mapInArrow(run, CHUNKS)


def records(parts: DataFrame) -> DataFrame:
    """(rid, id, bytes, sha1, type, refers_to) of chunks(): of equal payloads the one with the largest id is the response.

    Payloads are equal if length, SHA-1 and SHA-256 are. Only the last chunks' numbers are read, grouped and joined.
    """
    rows = parts.where("last").select("rid", "id", "bytes", "sha1", "sha256")
    groups = rows.groupBy("sha256", "sha1", "bytes").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups, "warc-repeats")
    total = groups.agg(F.sum("n")).first()[0] or 0
    key = F.struct("sha256", "sha1", "bytes")
    repeats = groups.select(key.alias("key"), "refers_to", "n")
    known = join_counted(rows.withColumn("key", key).select("key", "rid", "id"), repeats, "key", "n", total) if total else rows.select("rid", "id").withColumn("refers_to", F.lit(None).cast("long")).limit(0)
    revisits = known.where(F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))).select("rid", "refers_to")
    out = rows.join(revisits, "rid", "left")
    return out.select("rid", "id", "bytes", "sha1", F.when(F.col("refers_to").isNotNull(), F.lit("revisit")).otherwise(F.lit("response")).alias("type"), "refers_to")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row into gzipped archives under folder; (archive, records) of those that are complete.

    Archives have names of their own for each attempt of a task; only those that the returned table lists count. Null
    payloads are empty. Rows that repeat an id and a payload are all responses, if that id is the largest. The chunks of a
    record that has several come to one task in order, which streams them; a revisit's chunks but the first stay behind.
    """
    parts = materialise(chunks(pages, id_col, url_col, payload_col), "warc-chunks")
    about = materialise(records(parts), "warc-records")
    # what a record's first chunk needs to know of the whole
    about = about.select("rid", "type", "refers_to", F.col("sha1").alias("whole_sha1"), F.col("bytes").alias("whole"))
    several = (F.col("type") == "response") & (F.col("whole") > CHUNK)
    size, long = about.agg(F.sum(F.when(several, F.col("whole"))), F.count(F.when(several, 1))).first()
    tasks = max(-(-(size or 0) // TASK_BYTES), -(-long // TASK_RECORDS), 1)
    rows = meet_by_number(parts.select("rid", "id", "url", "chunk", "data"), about, "warc-about").where("type = 'response' or chunk = 0")
    data = F.when(F.col("type") == "response", F.col("data")).otherwise(F.lit(b""))
    rows = rows.select("id", "url", "type", "refers_to", F.col("whole_sha1").alias("sha1"), F.col("whole").alias("bytes"), "rid", "chunk", data.alias("data"))
    # only records of several chunks move, to have theirs in one task and in order
    several = (F.col("type") == "response") & (F.col("bytes") > CHUNK)
    rows = rows.where(~several).unionByName(rows.where(several).repartition(min(tasks, TASKS), "rid").sortWithinPartitions("rid", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        done, out, member, name, size, count = [], None, None, "", 0, 0

        def end_member() -> None:
            nonlocal member
            if member:
                member.write(CRLF + CRLF)
                member.close()
                member = None

        def end_archive() -> None:
            nonlocal out, size, count
            end_member()
            if out:
                out.close()
                done.append((name, count))
            out, size, count = None, 0, 0

        for batch in batches:
            columns = {n: batch.column(n) for n in ("id", "url", "type", "refers_to", "sha1", "bytes", "chunk")}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                if row["chunk"] == 0:
                    end_member()
                    if size >= archive_bytes:
                        end_archive()
                    if out is None:
                        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(name, compression=None)
                    member = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0)
                    member.write(_head(row))
                    count += 1
                data = batch.column("data")[i].as_buffer()
                member.write(data)
                size += data.size
        end_archive()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done]), pa.array([n for _, n in done], pa.int64())], ["archive", "records"])

    return materialise(rows.mapInArrow(run, "archive string, records long"), "warc-manifest")


def _headers(stream: gzip.GzipFile) -> dict[str, str]:
    out = {}
    while (line := stream.readline(1 << 16)) not in (CRLF, b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(stream: gzip.GzipFile, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunks of the records in a stream, in order: numbers, bytes so far and digest so far; the last one is marked.

    No more than a chunk is held. A payload that differs from its length or digest header raises ValueError.
    """
    while True:
        line = stream.readline(1 << 16)
        if not line:
            return
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = _headers(stream)
        left = int(head["content-length"])
        status = stream.readline(1 << 16)
        http_bytes, http = len(status), {}
        while True:
            line = stream.readline(1 << 16)
            http_bytes += len(line)
            if line in (CRLF, b""):
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            http[name.strip().lower()] = value.strip()
        left -= http_bytes
        number = head.get("x-record-number")
        row = {"record": head["warc-record-id"], "id": int(number) if number else None, "url": json.loads(head["x-url"]) if "x-url" in head else head.get("warc-target-uri", ""), "type": head["warc-type"]}
        stated, refers = head["warc-payload-digest"].removeprefix("sha1:"), head.get("x-refers-to-number")
        row["refers_to"] = int(refers) if refers and re.fullmatch(r"-?\d+", refers) else None
        if row["type"] == "revisit":
            if left:
                raise ValueError(f"{row['record']}: a revisit with a payload")
            yield row | {"chunk": 0, "data": b"", "bytes": int(http["content-length"]), "digest": stated, "last": True}
            continue
        digest, k, seen = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            left, seen = left - len(data), seen + len(data)
            digest.update(data)
            if left and not data:
                raise ValueError(f"{row['record']}: cut short")
            so_far = base64.b32encode(digest.digest()).decode()
            if not left and (so_far != stated or seen != int(http["content-length"])):
                raise ValueError(f"{row['record']}: payload differs from its digest or length")
            yield row | {"chunk": k, "data": data, "bytes": seen, "digest": so_far, "last": not left}
            if not left:
                break
            k += 1


FIELDS = [("record", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())]


def read(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Chunk rows of all archives that the manifest lists: record, id, url, type, refers_to, chunk, data, bytes and digest
    so far, last. Without payload, data is null (length and digest are still of the streamed bytes)."""
    schema = "record string, id long, url string, type string, refers_to long, chunk int, data binary, bytes long, digest string, last boolean"

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] if payload or n != "data" else None for r in rows], t) for n, t in FIELDS], [n for n, _ in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for listed in batches:
            for name in listed.column(0).to_pylist():
                held, rows = 0, []
                with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in parse(stream):
                        rows.append(row)
                        held += len(row["data"]) if payload else 0
                        if held >= 1 << 23 or len(rows) >= 2000:
                            yield batch(rows)
                            held, rows = 0, []
                if rows:
                    yield batch(rows)

    # a task for each archive: a number given to repartition() is kept, where a key alone would be coalesced by its few bytes
    archives = manifest.count()
    return manifest.select("archive").repartition(max(1, min(archives, TASKS))).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages as archives under the shared folder and read them back: a row for each record, from its last chunk."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write(pages, folder, id_col, url_col, payload_col)
    return read(manifest, folder, payload=False).where("last").select("id", "url", "bytes", "digest", "type", "refers_to")
