"""Files read inside tasks, a block at a time; the store may be any that Arrow knows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
MAX_TASKS = 10_000
TASKS_PER_CORE = 16  # of files that may be small; so many that a few large ones don't hold up the others


def tasks_by_cores(spark: SparkSession) -> int:
    """A limit for ``dealt`` where files may be small and many: a task that opens one mostly waits for its start."""
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def dealt(files: DataFrame, most: int = MAX_TASKS) -> DataFrame:
    """A table of files with one of them a task, or evenly many where there are more than ``most``.

    Names are short, so Spark would merge partitions by their size and let one task read everything.  The
    number of partitions is given here, and the names are dealt one by one from a single list.
    """
    listed = files.coalesce(1).withColumn("_n", F.monotonically_increasing_id())
    return listed.repartitionByRange(max(1, min(files.count(), most)), "_n").drop("_n")


def read_blocks(path: str, size: int = BLOCK) -> Iterator[bytes]:
    """The bytes of ``path``, a URI or a local path, front to back."""
    uri = re.sub(r"^file:/+", "file:///", path)
    store, name = fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)
    with store.open_input_stream(name, compression=None) as stream:
        while block := stream.read(size):
            yield block


def gunzip_lines(blocks: Iterator[bytes], size: int = 8 << 20) -> Iterator[tuple[list[str], bool]]:
    """(whole lines, complete) for each inflated piece of a gzip file of any number of members.

    The last item tells by ``complete`` whether the file's end was found; a damaged or cut file gives its
    lines as far as they reach, and no half line.
    """
    tail, held, member = b"", b"", None
    sound = True
    for block in blocks:
        held += block
        while held and sound:
            member = member or zlib.decompressobj(wbits=31)
            try:
                data = member.decompress(held, size)
            except zlib.error:
                sound = False
                break
            held = member.unused_data if member.eof else member.unconsumed_tail
            if member.eof:
                member = None
            *whole, tail = (tail + data).split(b"\n")
            yield [w.decode("utf-8", "replace") for w in whole], True
        if not sound:
            break
    complete = sound and member is None
    yield ([tail.decode("utf-8", "replace")] if tail and complete else []), complete
