"""WARC archives: writing, and normalising monolithic gzip files.

An archive compressed as one gzip stream cannot be read at a record.  The normaliser
inflates such a stream once, front to back, writes every record as a gzip member of its own
and beside the archive an index of (record id, type, offset, length); after that any record
is one seek and one inflate.  Memory is one record and one window of the stream.

Records with equal payloads are stored once: the one with the largest page id holds the
payload, the others are ``revisit`` records that refer to it.  Equal payloads are found by
an aggregate of digests with map-side combine and joined back; the join is a plain
sort-merge join, which Spark splits where one payload is very frequent.

Files are written to the folder given by the caller, which all executors must reach; names
hold the task attempt, so a task that runs twice leaves a spare file that no index or row
mentions.  Python's ``pyarrow.fs`` opens them, local or in a remote store.

Edge cases: a null payload is empty; a null page id never holds others' payloads; rows that
repeat a page id are records each; an unreadable or truncated archive keeps its whole records
and says so in ``error``; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "path string, index_path string, records long, bytes long, error string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WINDOW, _CHUNK = 1 << 16, 1 << 18


def with_record_types(pages: DataFrame, least: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, url, payload, digest, and ``holder``: the page whose record has the payload, null for responses."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    shared = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(
        F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = rows.join(shared, ["digest", "size"], "left")
    is_copy = F.col("holder").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("holder")))
    return joined.select("page_id", "url", "payload", "digest", F.when(is_copy, F.col("holder")).alias("holder"))


def _uri(page_id, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def _clean(url: str | None) -> str:
    """A header value: control characters are escaped."""
    return "".join(c if ord(c) >= 32 else f"%{ord(c):02X}" for c in url or "")


def record(page_id, url, payload: bytes, digest: str, holder) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if holder is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if holder is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if holder is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(holder, digest)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[:int(headers.get("content-length") or 0)]


def _new_name(folder: str, part: int) -> str:
    task = TaskContext.get()
    who = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
    return f"{folder.rstrip('/')}/part-{who[0]:06d}-{who[1]}-{part:04d}.warc.gz"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    cols = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def write_monolithic(records: DataFrame, folder: str, file_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write the records as archives of one gzip stream each, of about ``file_bytes`` before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, out, squeeze, n, size, path = [], None, None, 0, 0, ""

        def finish() -> None:
            nonlocal out
            out.write(squeeze.flush())
            out.close()
            made.append((path, None, n, size, None))
            out = None

        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None:
                        path = _new_name(folder, len(made))
                        store, at = fs.FileSystem.from_uri(path)
                        store.create_dir(at.rpartition("/")[0], recursive=True)
                        out, squeeze, n, size = store.open_output_stream(at, compression=None), zlib.compressobj(level, wbits=31), 0, 0
                    data = record(*row)
                    out.write(squeeze.compress(data))
                    n, size = n + 1, size + len(data)
                    if size >= file_bytes:
                        finish()
        if out is not None:
            finish()
        if made:
            yield _rows(made, FILES)

    return records.select("page_id", "url", "payload", "digest", "holder").mapInArrow(run, FILES)


def inflate(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of any number of members, at most ``_CHUNK`` at a time
    however well it is compressed; raises zlib.error or EOFError when it is damaged."""
    engine, fresh = zlib.decompressobj(wbits=31), True
    while data := stream.read(_WINDOW):
        while data:
            fresh = False
            yield engine.decompress(data, _CHUNK)
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine, fresh = zlib.decompressobj(wbits=31), True
    while not fresh and (rest := engine.decompress(b"", _CHUNK)):
        yield rest
    if not fresh and not engine.eof:
        raise EOFError("the gzip stream ends early")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with their closing blank lines, from a stream of inflated bytes."""
    held, need, seen = bytearray(), 0, 0
    for chunk in chunks:
        held += chunk
        while len(held) >= max(need, 1):
            if not need:
                end = held.find(b"\r\n\r\n", max(0, seen - 3))
                if end < 0:
                    seen = len(held)
                    break
                headers, _ = parse_record(bytes(held[:end + 4]))
                if not held.startswith(b"WARC/") or not headers.get("content-length", "").isdigit():
                    raise ValueError("not a WARC record")
                need = end + 4 + int(headers["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = seen = 0
    if held:
        raise EOFError("the last record ends early")


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive of ``files.path`` with one gzip member per record and a sidecar index."""

    def one(path: str, part: int) -> tuple:
        store, at = fs.FileSystem.from_uri(path)
        target = _new_name(folder, part)
        out_store, out_at = fs.FileSystem.from_uri(target)
        out_store.create_dir(out_at.rpartition("/")[0], recursive=True)
        n, offset, error = 0, 0, None
        with store.open_input_stream(at, compression=None) as src, out_store.open_output_stream(
                out_at, compression=None) as out, out_store.open_output_stream(out_at + ".idx", compression=None) as index:
            try:
                for data in split_records(inflate(src)):
                    squeeze = zlib.compressobj(level, wbits=31)
                    member = squeeze.compress(data) + squeeze.flush()
                    headers, _ = parse_record(data)
                    entry = {"id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "offset": offset, "length": len(member)}
                    out.write(member)
                    index.write(json.dumps(entry).encode() + b"\n")
                    n, offset = n + 1, offset + len(member)
            except (zlib.error, EOFError, ValueError) as e:
                error = str(e)
        return target, target + ".idx", n, offset, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield _rows([one(path, part)], FILES)
                part += 1

    return files.select("path").mapInArrow(run, FILES)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"


def _page_of(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").split(":")
    return int(name[2]) if len(name) > 3 and name[2].lstrip("-").isdigit() else None


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of the normalised archives, each read at its offset in the index.

    ``intact``: the payload has the digest its header names (a revisit: has no payload)."""

    def of(data: bytes) -> tuple:
        headers, block = parse_record(data)
        http, _, payload = block.partition(b"\r\n\r\n")
        named = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        if headers["warc-type"] == "revisit":
            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
            return (_page_of(headers["warc-record-id"]), size, named, "revisit", _page_of(headers["warc-refers-to"]),
                    headers["warc-target-uri"], not payload)
        digest = hashlib.sha1(payload).hexdigest()
        return (_page_of(headers["warc-record-id"]), len(payload), digest, "response", None, headers["warc-target-uri"], digest == named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = fs.FileSystem.from_uri(path)
                index_store, index_at = fs.FileSystem.from_uri(index)
                rows = []
                with store.open_input_file(at) as archive, index_store.open_input_stream(index_at, compression=None) as lines:
                    for line in io.BufferedReader(lines):
                        entry = json.loads(line)
                        rows.append(of(zlib.decompress(archive.read_at(entry["length"], entry["offset"]), wbits=31)))
                        if len(rows) >= 5000:
                            yield _rows(rows, RECORDS)
                            rows = []
                if rows:
                    yield _rows(rows, RECORDS)

    return archives.select("path", "index_path").mapInArrow(run, RECORDS)


def one_file_a_task(files: DataFrame) -> DataFrame:
    """Spread a table of files, one row each, so that tasks get about one file each."""
    n = files.count()
    return files.repartitionByRange(n, "path") if n > 1 else files
