"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(64 * x) per component.  Queries and candidates are packed into blocks, every
query block meets every candidate block (a stated query set against all rows), and scores are integer inner
products, computed exactly.  No pass keeps scores:

1. Each pass scores everything and counts, per query, the scores in ``BINS`` equal bins of the query's current
   range.  A block sends a query's bins from the top down to its own kth score only, since lower bins can't
   hold the global kth.  Global counts locate the bin of the kth score, which is the next pass's range, until a
   bin is one value.
2. The last pass sends the scores above the kth and, of its ties, the smallest ids that can still be needed.

So a query and block send at most 2 k counts or rows, whatever the ties.  Ties go to the smaller vec_id.
Rows with null or non-finite components or without vec_id take no part.  Vectors of different lengths are scored
over the components that both have; no shared ones: 0.
Repeated rows of a vec_id are candidates each for themselves; as a query the id is asked once, with its
smallest vector.  A query's own id is never its candidate.  Fewer than k candidates: all of them.  A score of
more than 61 bits raises.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.session import cut

SCALE = 64
BINS = 1024
QUERY_BLOCK = 1024
ROW_BLOCK = 8192
LIMIT = 1 << 61


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows whose components are all finite, as integers in doubles; of one length, padded with zeros."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    # What only the longest row has meets nothing, so the second length is enough.
    sizes = [r["n"] for r in rows.select(F.size("embedding").alias("n")).orderBy(F.desc("n")).limit(2).collect()]
    width = max(1, min(sizes, default=1))
    whole = F.transform(F.slice(v, 1, width), lambda x: F.floor(x * SCALE).cast("double"))
    padded = F.concat(whole, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(whole)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), padded.alias("v"))


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _packed(v: np.ndarray) -> np.ndarray:
    """Components in the smallest kind of integer that holds them all, if one does."""
    most = np.abs(v).max(initial=0)
    return next((v.astype(kind) for kind in (np.int8, np.int16, np.int32) if most <= np.iinfo(kind).max), v)


def _vectors(body: bytes, n: int, d: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}[len(body) // (n * d)]
    return np.frombuffer(body, kind).reshape(n, d)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, so that a batch's blocks aren't all copied at once."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(ids, vectors, d, name): rows packed by the thousands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            flat = v.flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // len(ids) if len(ids) else 0
            at = range(0, len(ids), size)
            heads, bodies = _binary([ids[i : i + size] for i in at]), _binary([_packed(flat[i * width : (i + size) * width]) for i in at])
            yield pa.RecordBatch.from_arrays([heads, bodies, pa.array([width] * len(at), pa.int32())], ["ids", "vectors", "d"])

    return cut(rows.mapInArrow(run, "ids binary, vectors binary, d int").withColumn(name, F.monotonically_increasing_id()))


def _own(qid: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a query and itself; a block's queries differ."""
    order = np.argsort(qid)
    at = order[np.minimum(np.searchsorted(qid[order], cid), len(qid) - 1)]
    columns = np.flatnonzero(qid[at] == cid)
    return at[columns], columns


def _scores(q: np.ndarray, v: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact integer inner products, queries x candidates; pairs in ``own`` are below every score."""
    bound = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(v).max(initial=0))
    if bound < 2**53:  # every partial sum is an integer that a double, or even a float, holds
        kind = np.float32 if bound < 2**24 else np.float64
        score = q.astype(kind) @ v.astype(kind).T
        score[own] = -np.inf
        return score
    exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T
    exact[own] = 0
    if exact.size and max(exact.max(), -exact.min()) >= LIMIT:
        raise OverflowError("a score needs more than 61 bits")
    exact = exact.astype(np.int64)
    exact[own] = np.iinfo(np.int64).min
    return exact


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    qid, cid = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
    q, v = (_vectors(row[name], len(ids), row["d"]).astype(np.float64) for name, ids in (("qvectors", qid), ("vectors", cid)))
    return qid, cid, _scores(q, v, _own(qid, cid))


def _from(score: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the scores that reach their row's ``low``, by rows.

    A limit that floats don't hold lies beyond all scores that are floats, and rounding leaves it there.
    """
    r, c = np.nonzero(score >= low.astype(score.dtype)[:, None])
    return r, c, score[r, c].astype(np.int64)


def _place_in_row(r: np.ndarray) -> np.ndarray:
    return np.arange(len(r)) - np.searchsorted(r, r)


def _kth_at_least(score: np.ndarray, k: int, low: np.ndarray) -> np.ndarray:
    """A limit per row that no more than the row's kth score and ``low`` reach: the kth of the highest of 4 k groups."""
    groups = 4 * k
    each = score.shape[1] // groups
    if each < 2:
        return low.astype(score.dtype)
    highest = score[:, : each * groups].reshape(len(score), each, groups).max(axis=1)
    return np.maximum(low.astype(score.dtype), np.partition(highest, groups - k, axis=1)[:, groups - k])


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                qid, _, score = _pairs(row)
                low, width = np.frombuffer(row["low"], np.int64), np.frombuffer(row["width"], np.int64)
                r, _, s = _from(score, _kth_at_least(score, k, low))
                order = np.lexsort((-s, r))
                r, s = r[order], s[order]
                # Below the block's own kth score nothing can be the global kth.
                kth, last = low.copy(), _place_in_row(r) == k - 1
                kth[r[last]] = s[last]
                r, s = r[s >= kth[r]], s[s >= kth[r]]
                bins = np.minimum((s - low[r]) // width[r], BINS)
                first = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(bins, prepend=-1) != 0))
                n = np.minimum(np.diff(first, append=len(r)), k)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (qid[r[first]], bins[first], n)], ["qid", "bin", "n"])

    return run


def _collect(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                qid, cid, score = _pairs(row)
                kth = np.frombuffer(row["low"], np.int64)
                r, c, s = _from(score, kth)
                order = np.lexsort((cid[c], s == kth[r], r))
                r, c, s = r[order], c[order], s[order]
                tied = np.flatnonzero(s == kth[r])
                picked = np.concatenate([np.flatnonzero(s > kth[r]), tied[_place_in_row(r[tied]) < k]])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[r[picked]], cid[c[picked]], s[picked])], ["query_id", "vec_id", "score"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which block a query is in, and its place there."""
    for batch in batches:
        for block, ids in zip(batch.column("qb").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            qid = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qid), block)), pa.array(qid), pa.array(np.arange(len(qid), dtype=np.int32))], ["qb", "qid", "at"])


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with the current ranges of those queries that still have one."""
    for batch in batches:
        ids, vectors, low, width = [], [], [], []
        for row in _rows(batch):
            at = np.array([s["at"] for s in row["s"]], np.int64)
            qid = np.frombuffer(row["ids"], np.int64)
            ids.append(qid[at])
            vectors.append(_vectors(row["vectors"], len(qid), row["d"])[at])
            low.append(np.array([s["low"] for s in row["s"]], np.int64))
            width.append(np.array([s["width"] for s in row["s"]], np.int64))
        yield pa.RecordBatch.from_arrays([_binary(x) for x in (ids, vectors, low, width)], ["qids", "qvectors", "low", "width"])


def _meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An equi join by shuffles: blocks are far larger than their files, and repeated ones are planned by the size of one."""
    return left.join(right.hint("merge"), key)


def _first_ranges(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, low, width): per query a range that holds every possible score."""
    top = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    reach = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)) * top
    high = F.floor(F.least(reach * 1.000001, F.lit(float(LIMIT)))).cast("long") + 1  # doubles round by far less
    return queries.select(F.col("vec_id").alias("qid"), (-high).alias("low"), (F.floor(high * 2 / BINS) + 1).cast("long").alias("width"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best candidates."""
    rows = usable(vectors)
    asked = cut(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    right = _blocks(rows, row_block, "cb")
    left = _blocks(asked, query_block, "qb")
    cells = max(1, right.count())
    right = right.withColumn("cell", F.pmod(F.xxhash64("cb"), F.lit(cells)))
    place = cut(left.select("qb", "ids").mapInArrow(_places, "qb long, qid long, at int"))
    state = cut(_first_ranges(asked, rows))

    def blocks_with(state: DataFrame) -> DataFrame:
        """Every query block beside every candidate block."""
        held = _meet(place, state, "qid").groupBy("qb").agg(F.array_sort(F.collect_list(F.struct("at", "low", "width"))).alias("s"))
        sent = cut(_meet(left, held, "qb").mapInArrow(_attach, "qids binary, qvectors binary, low binary, width binary"))
        repeated = sent.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
        # A task for each candidate block: their work is alike, and sizes say little about it.
        return _meet(repeated.repartition(cells, "cell"), right.repartition(cells, "cell"), "cell")

    while True:
        counts = blocks_with(state).mapInArrow(_count(k), "qid long, bin long, n long").groupBy("qid", "bin").agg(F.sum("n").alias("n"))
        # At most BINS + 1 bins a query.
        bins = counts.groupBy("qid").agg(F.reverse(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("b"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bin"))
        found = F.aggregate("b", start, lambda s, b: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + b["n"]).alias("n"), b["bin"].alias("bin"))))
        low = F.col("low") + F.col("f.bin") * F.col("width")
        narrower = F.ceil(F.col("width") / BINS).cast("long")
        # Queries without candidates end here.
        state = cut(_meet(state, bins.select("qid", found.alias("f")), "qid").select("qid", low.alias("low"), narrower.alias("width"), (F.col("width") == 1).alias("exact")))
        if state.where("NOT exact").isEmpty():
            break
    best = blocks_with(state).mapInArrow(_collect(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
