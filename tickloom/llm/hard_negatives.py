"""Hard-negative mining with Kronecker-packed products.

Components become integers, floor(256 * x).  The inner products of an anchor with several candidates are one
product: the candidates' k-th components, each raised by a bias so that none is negative, stand in separated
fields of one wide integer, and that integer is multiplied once by the anchor's k-th component.  Summed over
k, and with the bias taken off again, every field holds one exact score:

    sum_k a[k] * W[k] = sum_i 2^(w*i) * (score_i + bias * sum(a))

Before it is unpacked, each field gets what makes it score_i + K, where K bounds every score of the table;
w is wide enough for 2 K, so fields never run into each other, whatever the values.  The steps:

1. One aggregation finds the bias and K, hence w.
2. Anchors and candidates are packed into blocks; every anchor block meets every candidate block (a stated
   query set against all rows), in cells that are dealt over the cluster.  No pass keeps scores.
3. The first pass gives each anchor its positives: the best ``positives`` rows of its label.
4. The second pass gives each (anchor, positive) the best ``negatives`` rows of other labels with
   80 * positive <= 100 * score <= 100 * positive.  A block sends at most that many rows per (anchor, positive),
   whatever the ties.

Higher scores come first, ties go to the smaller vec_id.  Rows without vec_id or label, with a null vector, or with
null or non-finite components take no part.  Vectors of different lengths are scored over the components that
both have.  Repeated rows of a vec_id are candidates each for themselves; as an anchor the id is asked once, with
its smallest (label, vector), and rows of the anchor's own id are neither positive nor negative.  An anchor without
another row of its label has no rows; a positive without a fitting negative has none either.  A component or score that
a long can't hold raises.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.session import cut

SCALE = 256
LANES = 256  # candidates in one wide integer
ANCHOR_BLOCK = 512
ROW_BLOCK = 4096
LOW, HIGH = 80, 100  # percent of the positive's score between which a negative lies


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): usable rows with integer components, padded with zeros to one length."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine)
    # What only the longest row has meets nothing, so the second length is enough.
    sizes = [r["n"] for r in rows.select(F.size("embedding").alias("n")).orderBy(F.desc("n")).limit(2).collect()]
    width = max(1, min(sizes, default=1))
    large = F.raise_error(F.lit("a component is too large for a long"))
    whole = F.transform(F.slice(x, 1, width), lambda c: F.when(F.abs(c * scale) < float(1 << 62), F.floor(c * scale)).otherwise(large).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(whole)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), padded.alias("v"))


class Fields:
    """Fields of ``size`` bytes: a bias that makes components non-negative, and K, which bounds every score."""

    def __init__(self, largest: int, anchor_sum: int):
        self.bias = largest
        self.bound = max(largest * anchor_sum, largest, 1)
        bits = (2 * self.bound).bit_length()
        self.size = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)

    def pack(self, values: np.ndarray) -> bytes:
        """Rows x components to one run of fields per component."""
        if self.size <= 8:
            return (values.T + self.bias).astype(f"<u{self.size}").tobytes()
        return b"".join((int(v) + self.bias).to_bytes(self.size, "little") for v in values.T.ravel())

    def wide(self, body: bytes, rows: int, width: int) -> np.ndarray:
        """Components x groups of LANES candidates, each a wide integer."""
        step, view = rows * self.size, memoryview(body)
        ends = [min(i + LANES, rows) * self.size for i in range(0, rows, LANES)]
        starts = [i * self.size for i in range(0, rows, LANES)]
        out = np.empty((width, len(starts)), object)
        for k in range(width):
            for g, (a, b) in enumerate(zip(starts, ends, strict=True)):
                out[k, g] = int.from_bytes(view[k * step + a : k * step + b], "little")
        return out

    def ones(self, rows: int) -> list[int]:
        """For each group of candidates an integer with a 1 in every field."""
        one = (1).to_bytes(self.size, "little")
        return [int.from_bytes(one * (min(i + LANES, rows) - i), "little") for i in range(0, rows, LANES)]

    def unpack(self, value: int, rows: int) -> np.ndarray:
        """The scores of a group, from fields that hold score + K."""
        raw = value.to_bytes(rows * self.size, "little")
        if self.size == 4:
            return np.frombuffer(raw, "<u4").astype(np.int64) - self.bound
        if self.size == 8:
            return (np.frombuffer(raw, "<u8") - np.uint64(self.bound)).view(np.int64)
        scores = [int.from_bytes(raw[i : i + self.size], "little") - self.bound for i in range(0, len(raw), self.size)]
        return np.array(scores, np.int64)  # raises if a long can't hold one

    def scores(self, anchors: np.ndarray, body: bytes, rows: int) -> Iterator[np.ndarray]:
        """For each anchor its scores with all candidates of a block."""
        wide, ones = self.wide(body, rows, anchors.shape[1]), self.ones(rows)
        sizes = [min(LANES, rows - i) for i in range(0, rows, LANES)]
        for anchor in anchors:
            parts = [int(c) for c in anchor]
            lift = self.bound - self.bias * sum(parts)
            products = np.array(parts, object) @ wide
            yield np.concatenate([self.unpack(p + one * lift, n) for p, one, n in zip(products, ones, sizes, strict=True)])


def _bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, np.int64).tobytes()


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows)


def _candidate_blocks(rows: DataFrame, fields: Fields) -> DataFrame:
    """(cb, ids, labels, body): candidates in order of vec_id, components in fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                values = _matrix(part.column("v"), len(ids))[order]
                labels = part.column("label").to_numpy(zero_copy_only=False)[order]
                columns = [[_bytes(ids[order])], [_bytes(labels)], [fields.pack(values)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["ids", "labels", "body"])

    return cut(rows.mapInArrow(run, "ids binary, labels binary, body binary").withColumn("cb", F.monotonically_increasing_id()))


def _anchor_blocks(anchors: DataFrame) -> DataFrame:
    """(aids, alabels, avalues, wanted, thresholds): anchors with the scores of their positives so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHOR_BLOCK):
                part = batch.slice(at, ANCHOR_BLOCK)
                found = part.column("found").to_pylist()
                columns = [
                    part.column("vec_id").to_numpy(zero_copy_only=False), part.column("label").to_numpy(zero_copy_only=False),
                    _matrix(part.column("v"), part.num_rows), np.array([len(f) for f in found]), np.array([s for f in found for s in f]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([_bytes(c)], pa.binary()) for c in columns], ["aids", "alabels", "avalues", "wanted", "thresholds"])

    return cut(anchors.mapInArrow(run, "aids binary, alabels binary, avalues binary, wanted binary, thresholds binary"))


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Those of ``at`` with the ``k`` highest scores; ``at`` rises with the id, so ties go to smaller ids."""
    if len(at) > k:
        kth = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= kth]
    return at[np.argsort(-score[at], kind="stable")][:k]


def _mine(fields: Fields, k: int):
    """Per block pair: the anchors' best of their own label, or, once these are known, their hard negatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                aid, alabel, wanted, limits, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("aids", "alabels", "wanted", "thresholds", "ids", "labels"))
                anchors = np.frombuffer(row["avalues"], np.int64).reshape(len(aid), -1)
                first = np.concatenate([[0], np.cumsum(wanted)])
                out = []
                for a, score in enumerate(fields.scores(anchors, row["body"], len(ids))):
                    other = ids != aid[a]
                    if not len(limits):  # the first pass
                        best = _best(score, np.flatnonzero(other & (labels == alabel[a])), k)
                        out.append((np.full(len(best), aid[a]), np.zeros(len(best), np.int64), ids[best], score[best]))
                        continue
                    other &= labels != alabel[a]
                    for p, limit in enumerate(limits[first[a] : first[a + 1]].tolist()):
                        least = -(-LOW * limit // HIGH)
                        best = _best(score, np.flatnonzero(other & (score >= least) & (score <= limit)), k)
                        out.append((np.full(len(best), aid[a]), np.full(len(best), p), ids[best], score[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["anchor_id", "place", "vec_id", "score"])

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, embedding)."""
    rows = cut(whole_vectors(vectors))
    asked = cut(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v"))
    size = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + F.abs(c)).cast("decimal(38,0)"))
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    fields = Fields(int(largest), int(asked.agg(F.max(size)).first()[0] or 0))
    candidates = _candidate_blocks(rows, fields)
    cells = max(1, candidates.count())
    candidates = candidates.withColumn("cell", F.pmod(F.xxhash64("cb"), F.lit(cells))).drop("cb")

    def best(anchors: DataFrame, k: int) -> DataFrame:
        sent = _anchor_blocks(anchors).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
        found = sent.join(candidates.hint("merge"), "cell").drop("cell").mapInArrow(_mine(fields, k), "anchor_id long, place long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    like = cut(best(asked.withColumn("found", F.array().cast("array<long>")), positives).select("anchor_id", "rank", "vec_id", "score"))
    held = like.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("found"))
    unlike = best(asked.join(held.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), negatives)
    named = like.select("anchor_id", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return unlike.join(named, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
