"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become whole numbers, x = floor(1024 * c) + 100000.  With n rows of d entries and the exact sums S per
dimension, X holds the rows x - S/n.  The bidiagonalisation X V = U B goes step by step:

    r = X v_j - beta_{j-1} u_{j-1},   alpha_j u_j = r - U (U'r)
    p = X'u_j - alpha_j v_j,          beta_j v_{j+1} = p - V (V'p)

with full reorthogonalisation on both sides.  The long vectors u_j are never stored or collected: each is X w_j for
a w_j of d numbers, and a task makes its part of all of them from its own rows.  One distributed job a step
gives U'r, r'r and X'r, at most 2 d + 1 numbers; where r lies mostly in U's span, the job is repeated on
the rest.  The driver holds d x d numbers, never rows.  All d steps are taken unless ``steps`` says fewer, so that
equal eigenvalues are found too: if a new vector vanishes, a fixed random one, made orthogonal to the others, goes on.
The SVD of the small bidiagonal B gives the components (V times its right vectors) and the deviations: the covariance's
eigenvalues are the squared singular values over n.

Rows whose vector is null or holds null or non-finite entries are dropped; a null vec_id stays null; repeated rows
are rows each.  Vectors shorter than the longest are filled up with entries of 0; longer ones than ``MAX_WIDTH`` raise,
and so do entries that a long can't hold.  Components without variance are left out, so a table of equal vectors, an
empty table and a table of empty vectors give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut

SCALE, SHIFT = 1024, 100_000
MAX_WIDTH = 8192  # the driver keeps three matrices of this width
ROW_BLOCK = 4096
SEED = 12


def whole_entries(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): usable rows with whole entries, of one length."""
    c = F.col("embedding").cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where("embedding IS NOT NULL").where(fine)
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    if width > MAX_WIDTH:
        raise ValueError(f"a vector of {width} entries; at most {MAX_WIDTH} are possible")
    large = F.raise_error(F.lit("an entry is too large for a long"))
    whole = F.transform(c, lambda v: F.when(F.abs(v * SCALE) < float(1 << 61), F.floor(v * SCALE) + SHIFT).otherwise(large).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat(whole, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size(whole))).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(flat) // max(1, batch.num_rows))


def _summed(blocks: DataFrame, task, kind: str) -> dict[int, int | float]:
    """Position by position the sum of what ``task`` makes of each partition's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body, width in zip(batch.column("body"), batch.column("width").to_pylist(), strict=True):
                part = task(np.frombuffer(body.as_buffer(), np.int64).reshape(-1, width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "s"])

    kinds = {"exact": ("long", F.sum(F.col("s").cast("decimal(38,0)"))), "double": ("double", F.sum("s"))}
    schema, add = kinds[kind]
    return {r["k"]: r["s"] for r in blocks.mapInArrow(run, f"k int, s {schema}").groupBy("k").agg(add.alias("s")).collect()}


@dataclass
class Centre:
    """Exact sums per dimension over n rows; S / n = whole + rest / n."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s % self.n for s in self.sums]
        self.share = np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.share

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, as whole numbers of any size."""
        away = x - self.whole
        most = int(np.abs(away).max(initial=0))
        if most * max(most, self.n) * max(1, x.shape[1]) >= 1 << 62:
            away, rest = away.astype(object), np.array(self.rest, object)
        else:
            rest = np.array(self.rest, np.int64)
        square, mixed, last = (away * away).sum(axis=1).tolist(), (away @ rest).tolist(), sum(r * r for r in self.rest)
        return [self.n * self.n * a - 2 * self.n * b + last for a, b in zip(square, mixed, strict=True)]


def _centre(blocks: DataFrame) -> Centre | None:
    """The number of rows and the sums, added in two halves that can't overflow a task's longs."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)]).astype(np.int64)

    found = _summed(blocks, halves, "exact")
    if not found or len(found) == 1:
        return None
    d = (len(found) - 1) // 2
    return Centre(int(found[0]), [(int(found[1 + k]) << 31) + int(found[1 + d + k]) for k in range(d)])


@dataclass
class Whitening:
    centre: Centre
    components: np.ndarray  # d x k, unit columns by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x) @ self.components) / np.sqrt(self.eigenvalues)


class Bidiagonalisation:
    """Golub-Kahan-Lanczos on the centred rows of ``blocks``, with the long vectors kept as u = X w."""

    def __init__(self, blocks: DataFrame, centre: Centre):
        self.blocks, self.centre, self.d = blocks, centre, len(centre.sums)
        self.v, self.w, self.t = (np.zeros((self.d, 0)) for _ in range(3))  # columns v_j, w_j and X'u_j
        self.alpha: list[float] = []
        self.beta: list[float] = []
        self.frobenius = 0.0
        self.random = np.random.default_rng(SEED)

    def products(self, w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """U'r, r'r and X'r for r = X w."""
        centre, held = self.centre, np.column_stack([self.w, w])

        def task(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            long = rows @ held
            r = long[:, -1]
            return np.concatenate([long.T @ r, rows.T @ r, [np.vdot(rows, rows)]])

        found = _summed(self.blocks, task, "double")
        flat = np.array([found[k] for k in range(len(found))])
        j = self.w.shape[1]
        self.frobenius = float(np.sqrt(flat[-1]))
        return flat[:j], float(flat[j]), flat[j + 1 : -1]

    def _left(self, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """alpha, w and X'u of the next long vector."""
        w = v - self.beta[-1] * self.w[:, -1] if self.beta else v
        for _ in range(4):
            h, square, t = self.products(w)
            w, t = w - self.w @ h, t - self.t @ h
            rest = square - float(h @ h)
            if rest > 0.5 * square or square <= (np.finfo(float).eps * self.frobenius) ** 2:
                break
        alpha = float(np.sqrt(max(rest, 0.0)))
        if alpha <= 4 * np.finfo(float).eps * self.frobenius:
            return 0.0, np.zeros(self.d), np.zeros(self.d)
        return alpha, w / alpha, t / alpha

    def _orthogonal(self, p: np.ndarray) -> np.ndarray:
        for _ in range(2):
            p = p - self.v @ (self.v.T @ p)
        return p

    def _right(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """beta and the next short vector."""
        p = self._orthogonal(p)
        beta = float(np.linalg.norm(p))
        if beta > 4 * np.finfo(float).eps * self.frobenius:
            p = self._orthogonal(p / beta)
            return beta, p / np.linalg.norm(p)
        p = self._orthogonal(self.random.standard_normal(self.d))
        p = self._orthogonal(p / np.linalg.norm(p))
        return 0.0, p / np.linalg.norm(p)

    def run(self, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors in R^d, and the trace of X'X."""
        v = self.random.standard_normal(self.d)
        v /= np.linalg.norm(v)
        while True:
            alpha, w, t = self._left(v)
            self.v, self.w, self.t = (np.column_stack([a, b]) for a, b in ((self.v, v), (self.w, w), (self.t, t)))
            self.alpha.append(alpha)
            if len(self.alpha) == steps:
                break
            beta, v = self._right(t - alpha * self.v[:, -1])
            self.beta.append(beta)
        _, sigma, right = np.linalg.svd(np.diag(self.alpha) + np.diag(self.beta, 1))
        return sigma, self.v @ right.T, self.frobenius**2


def fit_whitening(blocks: DataFrame, components: int = 8, steps: int | None = None) -> Whitening | None:
    """The first ``components`` eigenvectors of the rows' covariance; None if there is no variance."""
    centre = _centre(blocks)
    if centre is None:
        return None
    sigma, vectors, square = Bidiagonalisation(blocks, centre).run(min(steps or len(centre.sums), len(centre.sums)))
    k = int((sigma[:components] > len(centre.sums) * np.finfo(float).eps * max(sigma[0], 1e-300)).sum())
    if k == 0:
        return None
    return Whitening(centre, vectors[:, :k], sigma[:k] ** 2 / centre.n, square / centre.n)


def packed_rows(rows: DataFrame) -> DataFrame:
    """(body, width): rows of (x) packed by the thousands and stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                x = _matrix(batch.slice(at, ROW_BLOCK))
                if x.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], ["body", "width"])

    return cut(rows.select("x").mapInArrow(run, "body binary, width int"))


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""

    def task(x: np.ndarray) -> np.ndarray:
        z = model.whitened(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found, k, n = _summed(blocks, task, "double"), len(model.eigenvalues), model.centre.n
    mean = np.array([found[i] for i in range(k)]) / n
    square = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = 8, steps: int | None = None) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) per usable row and component."""
    rows = cut(whole_entries(vectors))
    schema = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    blocks = packed_rows(rows)
    model = fit_whitening(blocks, components, steps)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    error, k, n = identity_error(blocks, model), len(model.eigenvalues), model.centre.n
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch), batch.num_rows
            which = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array([str(v) for v in model.centre.deviations(x)], pa.string()).take(which), pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
