"""Bounded venue books in batch: a ladder that forgets levels is no running sum, so it is run in epochs.

A snapshot replaces the whole ladder, hence what follows one depends on nothing before it.  Rows are dealt by
(key, snapshot count), and each task runs through its epochs in order with one ladder in memory, whatever their
length.  Rows before a key's first snapshot have no book.  The answers are those of the stream operator.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.slices import running
from tickloom.streaming.ladder import Ladder

ORDER = ("receive_ts_ms", "line", "part")
LEVEL = pa.list_(pa.struct([("price", pa.string()), ("qty", pa.string())]))
OUT = (
    "venue string, symbol string, receive_ts_ms bigint, line bigint, part int, status string, bids array<struct<price:string,qty:string>>, "
    "asks array<struct<price:string,qty:string>>, expected bigint, received bigint"
)
_ARROW = pa.schema([
    ("venue", pa.string()), ("symbol", pa.string()), ("receive_ts_ms", pa.int64()), ("line", pa.int64()), ("part", pa.int32()), ("status", pa.string()), ("bids", LEVEL), ("asks", LEVEL),
    ("expected", pa.int64()), ("received", pa.int64()),
])


def venue_books(updates: DataFrame, depth: int = 10, truncate: bool = False, verify_checksum: bool = False, width_ms: int = 3_600_000, keys: Sequence[str] = ("venue", "symbol")) -> DataFrame:
    """The book after every update that leaves it whole, from the rows of ``depth_updates``.

    Sequences over a connection aren't checked here (see the stream operator): the place that a message has to
    follow is known only from all messages before.
    """
    opened = running(updates, list(keys), ORDER[0], list(ORDER[1:]), width_ms, {"_epoch": ("sum", F.when(F.col("kind") == "snapshot", 1).otherwise(0).cast("long"))})
    held = opened.filter("_epoch > 0").select(*Ladder.COLUMNS, *keys, F.xxhash64(*keys, "_epoch").alias("_mark"), "_epoch")
    placed = held.repartition(*keys, "_epoch").sortWithinPartitions(*keys, "_epoch", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ladder, mark = None, None
        for batch in batches:
            out = []
            names = ("venue", "symbol", "_mark", *Ladder.COLUMNS)
            for venue, symbol, here, t, line, part, sequence, kind, checksum, bids, asks in zip(*(batch.column(c).to_pylist() for c in names)):
                if here != mark:
                    ladder, mark = Ladder(depth, truncate, False, verify_checksum), here
                if answer := ladder.answer(sequence, part, kind, checksum, bids, asks):
                    out.append({"venue": venue, "symbol": symbol, "receive_ts_ms": t, "line": line, "part": part, **answer})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return placed.mapInArrow(run, OUT)
