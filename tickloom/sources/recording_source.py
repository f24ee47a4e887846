"""A Spark data source for folders of recorded JSON lines: batch reader, stream reader and writer.

Recordings lie as ``root/<ticker>/<family>_<run>.jsonl`` or ``.jsonl.gz``.  Register the source once a session
(``register``), then use ``spark.read.format("recordings")``, ``spark.readStream.format("recordings")`` or
``df.write.format("recordings")``; ``tickloom.sources.recordings`` does so for its scans.

* **Reader.** Plain files are cut into parts at multiples of ``BLOCK_BYTES``; a packed file is one piece, read and
  inflated bit by bit.  A task reads as many neighbouring pieces as make up ``TASK_BYTES``, so the number of tasks
  grows with the bytes and not with the files.  A file cut short or damaged gives its whole lines as far as they reach, and a closing
  row whose ``complete`` is false.  Rows carry their place as (``block``, ``line``): the start of the
  block of the unpacked file in which the line begins, and its number among the block's lines.  Both depend on the
  file alone, so any cut into tasks gives the same places.
* **Pushed filters.** Comparisons of ``ticker``, ``day``, ``name`` and ``path`` with values choose files before any is
  opened.  ``day`` is the date in the file's name, or of its last change.
* **Stream reader.** A micro-batch holds the files that landed since the one before, in the order of their times of
  change.  Files have to be renamed into their folder when complete, as the writer does.
* **Writer.** Rows (ticker, fragment, suffix, value) become one file per ticker, fragment and task.  Tasks
  write under names that the reader passes over; files get their names only when the whole job commits.
"""

from __future__ import annotations

import datetime
import fnmatch
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    StringStartsWith, WriterCommitMessage,
)

NAME = "recordings"
BLOCK_BYTES = 8 << 20
READ_BYTES = 1 << 20
TASK_BYTES = 64 << 20  # that a task reads, unpacked
OPEN_BYTES = 128 << 10  # what opening a file costs, in bytes read meanwhile
INFLATION = 8  # bytes of a packed file's text for each of its own, about
TASKS_PER_CORE = 4  # at least, where there are so many pieces
ROWS = 4096  # of a batch
PENDING = "_pending-"  # names that begin with an underscore are passed over
SCHEMA = "path string, ticker string, name string, day date, modified timestamp, block bigint, line bigint, value string, complete boolean"
_ARROW = pa.schema([
    ("path", pa.string()), ("ticker", pa.string()), ("name", pa.string()), ("day", pa.date32()), ("modified", pa.timestamp("us", "UTC")), ("block", pa.int64()), ("line", pa.int64()),
    ("value", pa.string()), ("complete", pa.bool_()),
])
WRITTEN = "ticker string, fragment string, suffix string, value string"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified: int  # microseconds

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def ticker(self) -> str:
        return self.path.rsplit("/", 2)[-2] if self.path.count("/") else ""

    @property
    def day(self) -> datetime.date:
        if found := re.search(r"(?<!\d)(20\d\d)-?(\d\d)-?(\d\d)(?!\d)", self.name):
            try:
                return datetime.date(*map(int, found.groups()))
            except ValueError:
                pass
        return (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=self.modified)).date()

    @property
    def packed(self) -> bool:
        return self.path.endswith(".gz")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)


def list_files(roots: Iterable[str], pattern: str) -> list[File]:
    """Files under the roots (or the roots themselves) whose names fit, in the order of their paths."""
    found = {}
    for root in roots:
        store, base = store_of(root)
        head = root[: len(root) - len(base)] if root.endswith(base) else ""
        info = store.get_file_info(base)
        listed = store.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else [info]
        for f in listed:
            inner = f.path[len(base) :]
            if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in inner.split("/")) and any(fnmatch.fnmatchcase(f.base_name, p) for p in pattern.split("|")):
                found[head + f.path] = File(head + f.path, f.size, f.mtime_ns // 1000)
    return [found[p] for p in sorted(found)]


_CHECKS = {
    EqualTo: lambda a, f: a == f.value, In: lambda a, f: a in f.value, GreaterThan: lambda a, f: a > f.value, GreaterThanOrEqual: lambda a, f: a >= f.value,
    LessThan: lambda a, f: a < f.value, LessThanOrEqual: lambda a, f: a <= f.value, StringStartsWith: lambda a, f: a.startswith(f.value),
}
FILE_COLUMNS = ("ticker", "day", "name", "path")


class Piece:
    """The lines of a file that begin within [low, high); a packed file is always whole."""

    def __init__(self, file: File, low: int, high: int) -> None:
        self.file, self.low, self.high = file, low, high


def pieces(file: File, part: int) -> list[Piece]:
    if file.packed or file.size <= part:
        return [Piece(file, 0, file.size)]
    return [Piece(file, low, min(low + part, file.size)) for low in range(0, file.size, part)]


class Bundle(InputPartition):
    """The pieces that one task reads."""

    def __init__(self, held: list[Piece]) -> None:
        self.held = held


def bundles(found: Iterable[Piece], cores: int) -> list[Bundle]:
    """Neighbouring pieces in bundles of about equal cost, no piece cut and none left out."""
    costed = [(p, (p.high - p.low) * (INFLATION if p.file.packed else 1) + OPEN_BYTES) for p in found]
    most = min(TASK_BYTES, sum(cost for _, cost in costed) // (TASKS_PER_CORE * max(1, cores)))
    out, room = [], 0
    for piece, cost in costed:
        if not out or cost > room:
            out.append(Bundle([]))
            room = most
        out[-1].held.append(piece)
        room -= cost
    return out


class _Lines:
    """Rows of a file in batches, each with its block and its number there."""

    def __init__(self, file: File, start: int, size: int) -> None:
        self.file, self.at, self.size = file, start, size  # at: where the next line begins
        self.block, self.number = -1, 0
        self.blocks, self.numbers, self.values = [], [], []

    def add(self, line: bytes) -> None:
        block = self.at // self.size * self.size
        if block != self.block:
            self.block, self.number = block, 0
        self.blocks.append(block)
        self.numbers.append(self.number)
        self.values.append(line.decode("utf-8", "replace"))
        self.number += 1
        self.at += len(line) + 1

    def batch(self, complete: bool = True) -> pa.RecordBatch:
        n, f = len(self.values), self.file
        same = [pa.repeat(pa.scalar(v, t), n) for v, t in zip((f.path, f.ticker, f.name, f.day, f.modified), _ARROW.types)]
        own = [pa.array(c, t) for c, t in zip((self.blocks, self.numbers, self.values), _ARROW.types[5:])]
        self.blocks, self.numbers, self.values = [], [], []
        return pa.RecordBatch.from_arrays([*same, *own, pa.repeat(pa.scalar(complete), n)], schema=_ARROW)


def _chunks(stream) -> Iterator[bytes]:
    while chunk := stream.read(READ_BYTES):
        yield chunk


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes | None]:
    """The unpacked bytes of all members; None at the end if that wasn't the file's end."""
    member, held = None, b""
    for chunk in chunks:
        held += chunk
        while held:
            member = member or zlib.decompressobj(wbits=31)
            try:
                data = member.decompress(held, BLOCK_BYTES)
            except zlib.error:
                yield None
                return
            held = member.unused_data if member.eof else member.unconsumed_tail
            if member.eof:
                member = None
            yield data
    if member is not None:
        yield None


def read_piece(piece: Piece, block: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The piece's lines; the file's first piece closes with a row without text that says whether it is complete."""
    store, name = store_of(piece.file.path)
    complete = True
    with store.open_input_stream(name, compression=None) if piece.file.packed else store.open_input_file(name) as stream:
        rows, tail, skip = _Lines(piece.file, piece.low, block), b"", False
        if piece.low:  # the line that is under way belongs to the piece before
            stream.seek(piece.low - 1)
            rows.at, skip = piece.low - 1, True
        for data in _inflated(_chunks(stream)) if piece.file.packed else _chunks(stream):
            if data is None:
                complete = False
                break
            *whole, tail = (tail + data).split(b"\n")
            for line in whole:
                if skip:
                    rows.at, skip = rows.at + len(line) + 1, False
                elif rows.at >= piece.high and not piece.file.packed:
                    break
                else:
                    rows.add(line)
                    if len(rows.values) >= ROWS:
                        yield rows.batch()
            if not piece.file.packed and rows.at >= piece.high and not skip:
                break
        else:
            # A last line without an end counts; of a file cut short it may be half a line, and goes.
            if tail and not skip and (piece.file.packed or rows.at < piece.high):
                rows.add(tail)
    if rows.values:
        yield rows.batch()
    if piece.low == 0:
        rows.blocks, rows.numbers, rows.values = [0], [-1], [""]
        yield rows.batch(complete)


class RecordingReader(DataSourceReader):
    def __init__(self, roots: list[str], pattern: str, part: int, block: int, cores: int) -> None:
        self.roots, self.pattern, self.part, self.block, self.cores = roots, pattern, part, block, cores
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _CHECKS and len(f.attribute) == 1 and f.attribute[0] in FILE_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def chosen(self) -> list[File]:
        files = list_files(self.roots, self.pattern)
        return [f for f in files if all(_CHECKS[type(c)](getattr(f, c.attribute[0]), c) for c in self.filters)]

    def partitions(self) -> list[Bundle]:
        return bundles((p for f in self.chosen() for p in pieces(f, self.part)), self.cores) or [Bundle([])]

    def read(self, bundle: Bundle) -> Iterator[pa.RecordBatch]:
        for piece in bundle.held:
            yield from read_piece(piece, self.block)


class RecordingStream(DataSourceStreamReader):
    """Offsets are the time of change and the path of the last file taken."""

    def __init__(self, roots: list[str], pattern: str, part: int, block: int, cores: int) -> None:
        self.roots, self.pattern, self.part, self.block, self.cores = roots, pattern, part, block, cores

    def _landed(self) -> list[File]:
        return sorted(list_files(self.roots, self.pattern), key=lambda f: (f.modified, f.path))

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._landed()
        return {"modified": files[-1].modified, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Bundle]:
        low, high = (start["modified"], start["path"]), (end["modified"], end["path"])
        return bundles((p for f in self._landed() if low < (f.modified, f.path) <= high for p in pieces(f, self.part)), self.cores)

    def read(self, bundle: Bundle) -> Iterator[pa.RecordBatch]:
        for piece in bundle.held:
            yield from read_piece(piece, self.block)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # pending and final path


class RecordingWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite = root, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.root)
        run, done = uuid.uuid4().hex, []
        at, out, pack = None, None, None

        def close() -> None:
            if out is not None:
                if pack:
                    out.write(pack.flush())
                out.close()

        try:
            for batch in batches:
                for ticker, fragment, suffix, value in zip(*(batch.column(c).to_pylist() for c in ("ticker", "fragment", "suffix", "value"))):
                    if (ticker, fragment, suffix) != at:
                        close()
                        at, folder = (ticker, fragment, suffix), f"{root}/{ticker}"
                        store.create_dir(folder, recursive=True)
                        # A fragment whose rows come in several tasks becomes several files.
                        pending, final = f"{folder}/{PENDING}{run}-{len(done)}", f"{folder}/{fragment}-{run[:8]}-{len(done)}{suffix}"
                        done.append((pending, final))
                        out, pack = store.open_output_stream(pending, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31) if suffix.endswith(".gz") else None
                    data = value.encode() + b"\n"
                    out.write(pack.compress(data) if pack else data)
        finally:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.root)
        old = [] if not self.overwrite or store.get_file_info(root).type != fs.FileType.Directory else [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith("_")]
        for message in messages:
            for pending, final in message.files if message else ():
                store.move(pending, final)
        for path in old:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.root)
        for message in messages:
            for pending, _ in message.files if message else ():
                if store.get_file_info(pending).type == fs.FileType.File:
                    store.delete_file(pending)


class Recordings(DataSource):
    """Options: path or paths (a JSON list), pattern (names, set apart by bars), partBytes, blockBytes, cores."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _where(self) -> tuple[list[str], str, int, int, int]:
        roots = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        block = int(self.options.get("blockBytes", BLOCK_BYTES))
        part = int(self.options.get("partBytes", 128 << 20))
        return roots, self.options.get("pattern", "*"), max(1, part // block) * block, block, int(self.options.get("cores", 16))

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(*self._where())

    def streamReader(self, schema) -> RecordingStream:
        return RecordingStream(*self._where())

    def writer(self, schema, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
