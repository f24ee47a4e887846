"""WARC archives: a writer of one gzip member a record, and a sequential reader that checks what it reads.

``write_archives`` writes each partition's records to files of about ``ARCHIVE_BYTES`` and renames a file only
when it is complete, so a task that is run again leaves no half-written archive.  ``read_archives`` makes rows of
the files' names and reads each file in blocks of ``BLOCK`` bytes: it inflates member by member, frames headers
and body by Content-Length, and verifies block and payload digests.  Files are opened through Arrow's file
systems, so the folder may be on any store that they know; no file is held whole.

Payloads are the html in UTF-8 (null: empty).  Of equal payloads of at least ``REVISIT_BYTES`` the row with the
largest page_id is the response and the others revisit it: their body holds the HTTP head only, whose
Content-Length is that of the full payload.  If rows with the largest page_id repeat, each is a response.  A null
page_id is smaller than any other.  A damaged record raises ``DamagedArchive``.  An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.slices import keyed_join
from tickloom.session import checkpoint_dir, cut
from tickloom.sources.files import dealt

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
BLOCK = 1 << 18
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedArchive(ValueError):
    """A record that does not say what its header says."""


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (fs.LocalFileSystem(), folder)


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None,
        "WARC-Refers-To": f"<urn:page:{'null' if refers_to is None else refers_to}>" if revisit else None,
        "WARC-Profile": SAME if revisit else None,
        "WARC-Payload-Digest": _base32(hashlib.sha1(payload).digest()),
        "WARC-Block-Digest": _base32(hashlib.sha1(body).digest()),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(text.encode()) + deflate.compress(body) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): which rows repeat another row's payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    sums = large.select(F.sha1(F.col("payload").cast("binary")).alias("_sum"), "page_id").groupBy("_sum").agg(F.max("page_id").alias("_last"), F.count("*").alias("n"))
    repeated = cut(sums.where("n > 1").drop("n"))
    keyed = rows.withColumn("_sum", F.when(F.octet_length("payload") >= least, F.sha1(F.col("payload").cast("binary"))))
    joined = keyed_join(keyed, repeated, ["_sum"], ["page_id", "url"])
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("_last")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, revisit, refers_to) rows; returns a stored table of (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, path, count, size, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                store.move(path + ".open", path)
                done.append((path, count, size))
                out = None

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                page_id, url, payload, refers_to, revisit = (v.as_py() for v in row)
                if out is None:
                    path, count, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path + ".open", compression=None)
                data = record_bytes(page_id, url, payload.encode(), refers_to, revisit, date)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= most:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    # The table names what each task's accepted run wrote; files of other runs are never read.
    return cut(records.mapInArrow(run, "path string, records long, bytes long"))


def _members(stream, block: int) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member, read in order."""
    held = stream.read(block)
    while held:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal held
            while not inflate.eof:
                if not held:
                    raise DamagedArchive("the archive ends within a record")
                try:
                    piece = inflate.decompress(held, block)
                except zlib.error as error:
                    raise DamagedArchive(str(error)) from None
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail or stream.read(block)
                if piece:
                    yield piece

        part = pieces()
        yield part
        for _ in part:
            pass
        held = held or stream.read(block)


def _head(buffer: bytearray, pieces: Iterator[bytes]) -> dict[str, str]:
    """Take a header up to its blank line off the buffer."""
    while (at := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise DamagedArchive("a header without end")
        buffer += piece
    lines = bytes(buffer[:at]).decode("utf-8", "replace").split("\r\n")
    del buffer[: at + 4]
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_record(pieces: Iterator[bytes], keep: bool = True) -> dict:
    """Frame one record, check its digests, and return its fields; the payload only with ``keep``."""
    buffer = bytearray()
    warc = _head(buffer, pieces)
    if not warc[""].startswith("WARC/"):
        raise DamagedArchive(f"no WARC record: {warc['']!r}")
    left = int(warc["content-length"])
    block, payload, kept, size = hashlib.sha1(), hashlib.sha1(), bytearray(), 0
    http_text = bytearray()
    http: dict[str, str] | None = None
    while left:
        if not buffer:
            piece = next(pieces, None)
            if piece is None:
                raise DamagedArchive("a record shorter than its Content-Length")
            buffer += piece
        chunk = bytes(buffer[:left])
        del buffer[: len(chunk)]
        left -= len(chunk)
        block.update(chunk)
        if http is None:
            http_text += chunk
            if (at := http_text.find(b"\r\n\r\n")) < 0:
                continue
            chunk = bytes(http_text[at + 4 :])
            http = _head(http_text, iter(()))
        payload.update(chunk)
        size += len(chunk)
        if keep:
            kept += chunk
    rest = bytes(buffer) + b"".join(pieces)
    if rest != b"\r\n\r\n":
        raise DamagedArchive("a record longer than its Content-Length")
    revisit = warc["warc-type"] == "revisit"
    if _base32(block.digest()) != warc["warc-block-digest"] or (not revisit and _base32(payload.digest()) != warc["warc-payload-digest"]):
        raise DamagedArchive(f"wrong digest in {warc['warc-record-id']}")
    number = int(http["content-length"]) if http else 0
    if not revisit and number != size:
        raise DamagedArchive(f"wrong payload length in {warc['warc-record-id']}")

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", warc.get(name, ""))
        return int(found[1]) if found else None

    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    return {
        "page_id": page("warc-record-id"), "url": warc.get("warc-target-uri"), "payload_bytes": number, "payload_digest": digest,
        "record_type": warc["warc-type"], "refers_to": page("warc-refers-to"), "payload": bytes(kept) if keep and not revisit else None,
    }


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(files: DataFrame, folder: str, payloads: bool = True, block: int = BLOCK) -> DataFrame:
    """One row a record of the archives named by ``files`` (path); each file is read front to back, in a task of its own as long as they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    for pieces in _members(stream, block):
                        row = read_record(pieces, payloads)
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        if len(rows) >= 2000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, RECORD)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return dealt(files.select("path")).mapInArrow(run, schema)


def archive_folder(spark) -> str:
    """A new folder in the cluster's shared one."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
