"""Words and word shingles of a batch of texts as numpy arrays, for operators that work inside Arrow tasks.

A word is ``[^\\x20\\x09-\\x0D]+``.  All of a block's texts are handled at once on their UTF-8 bytes;
no text is cut.  Words and runs of words are named by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut

BLOCK_BYTES = 1 << 20  # of text handled at once; one longer text is a block of its own
BLOCK_ROWS = 1 << 15  # of a block: places of texts are packed in 16 bits
ROW_BITS = 40  # of a row id; the rest numbers files
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, np.ndarray] = {}


def with_row_id(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows of a stored table by file and place in the file; a table that has ``name`` stays as it is.

    doc_id may be null or repeated, so rows are told apart by where they stand.  Files count in the order of their
    paths, and a row's place in its Parquet file depends on nothing else: not on how a scan is cut into tasks, which
    moves with the cluster's parallelism, nor on reruns.  So rows of one scan can be joined with those of a later
    one.  A table that isn't a scan of Parquet files is written to the shared folder first; call this once for it.
    The list of files, which the driver makes for every scan, is the only thing broadcast.
    """
    if name in docs.columns:
        return docs
    placed = _placed(docs)
    if placed is None:
        placed = _placed(cut(docs))
    files = sorted({url for url in placed.inputFiles()})
    if len(files) >= 1 << (63 - ROW_BITS):
        raise ValueError(f"{len(files)} files; row ids have room for {1 << (63 - ROW_BITS)}")
    listed = docs.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(files)), "array<string>")).alias("_number", "_url"))
    # Paths are compared as they are listed: with their special characters encoded.
    number = listed.select("_url", F.shiftleft(F.col("_number").cast("long"), ROW_BITS).alias("_start"))
    joined = placed.join(F.broadcast(number), "_url")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), (F.col("_start") + F.col("_at")).alias(name))


def _placed(docs: DataFrame) -> DataFrame | None:
    """``docs`` with the file and the place of each row; None where Spark doesn't know them."""
    try:
        return docs.select("*", F.input_file_name().alias("_url"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return None


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing step of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of ``values[start:end]`` for every run, from one prefix sum modulo 2^64."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=sums[1:])
    inverse = _powers(pow(base, -1, 1 << 64), max(n, 1))
    at = np.minimum(starts, max(n - 1, 0))
    raw = (sums[ends] - sums[starts]) * inverse[at]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    doc: np.ndarray  # text of each word
    first: np.ndarray  # first word of each text, and the number of words
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of ``size`` words within one text."""
        n = len(self.hashes)
        starts = np.arange(max(0, n - size + 1), dtype=np.int64)
        starts = starts[self.doc[starts] == self.doc[starts + size - 1]] if len(starts) else starts
        return starts, run_hashes(self.hashes, starts, starts + size, _WORD_BASE)

    def whole(self, docs: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of each given text."""
        return run_hashes(self.hashes, self.first[docs], self.first[docs + 1], _WORD_BASE)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and each text's offset; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def words_of(texts: pa.Array, fold: bool = False) -> Words:
    """Words of every text; ``fold`` lower-cases A-Z."""
    data, off = text_bytes(texts)
    if fold:
        data = _FOLD[data]
    inside = ~_GAP[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = off[:-1][np.diff(off) > 0]
    before[edges] = False
    after[edges[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(off)))
    return Words(data, start, end, doc, first, run_hashes(data, start, end, _BYTE_BASE))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size and number."""
    for batch in batches:
        _, off = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            upto = min(upto, at + rows)
            yield batch.slice(at, upto - at)
            at = upto


def packed(parts: list[np.ndarray]) -> pa.Array:
    """Numpy arrays as a column of binary values."""
    return pa.array([p.tobytes() for p in parts], pa.binary())
