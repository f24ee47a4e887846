"""Mixing sources to target weights: rake token counts to marginals, then sample by the raked probabilities.

Iterative proportional fitting scales the tokens of each (source, language, topic) cell until the totals of
every source, language and topic meet their targets.  A cell's weight is its raked share over its share of the
corpus.  With a budget, a share of the corpus's tokens, a row is drawn budget x weight times: the whole copies of
that, and one more by chance for what is left.  So the targets hold and the size is the budget, however small the
rarest cell.  Without repeats the size is the budget too, but a cell can't give more than it has: it is kept whole,
and the others of its source, language or topic are raised until the marginals fit again (``capped``).  A category
whose target is more than all it has is kept whole, and the other categories share what it lacks.  Without a budget
probabilities are the weights over the largest weight, and one rare cell can make the sample small.

Targets default to each category's token share to the power ``TEMPERATURE``, which lifts small categories.
The cells are summed before the shuffle; only one row a cell reaches the driver and is broadcast back, and more
than ``MAX_CELLS`` cells (a few MB) are an error that asks for coarser categories.

Null categories are categories of their own (``NONE``).  Null and empty texts have no tokens and share their
cell's probability; a cell without any tokens has probability 1 and weight 0.  Rows with equal doc_id and text
are drawn together, and again in any rerun.  Where targets can't all be met (cells that would be needed are
empty) the fit stops after ``ROUNDS`` rounds at the nearest weights.  Extra columns stay; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPERATURE = 0.9
BUDGET = 1.0  # of the corpus's tokens, in the registered query
KEEP = 0.9  # of the corpus's tokens, in samples without repeats
MAX_CELLS = 100_000
ROUNDS = 500
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: str = "text") -> Column:
    """A coarse topic from the whole text; the first that fits."""
    t = F.col(text).cast("string")
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(t.rlike("(?i)licen[sc]e|copyright"), "legal")
        .when(t.rlike(r"[\w.]@\w+\.|://"), "contact")
        .when(t.contains(" | "), "table")
        .otherwise("prose")
    )


def _goals(cells: list[tuple], tokens: np.ndarray, targets: list[dict | None], temperature: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per dimension the category of each cell, and each category's target share."""
    total = tokens.sum()
    codes, goals = [], []
    for dim, wanted in enumerate(targets):
        names, code = np.unique(np.array([c[dim] for c in cells], object), return_inverse=True)
        held = np.bincount(code, weights=tokens)
        share = (held / total) ** temperature if wanted is None else np.array([wanted.get(n, 0.0) for n in names], float)
        share = np.where(held > 0, share, 0.0)
        if share.sum() == 0:
            raise ValueError("no category of the targets occurs in the corpus")
        codes.append(code)
        goals.append(share / share.sum())
    return codes, goals


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict | None], temperature: float = TEMPERATURE) -> np.ndarray:
    """Raked tokens per cell; ``cells`` holds one category per dimension, targets are shares per category."""
    total = tokens.sum()
    if not len(cells) or total == 0:
        return tokens.astype(float)
    codes, goals = _goals(cells, tokens, targets, temperature)
    w = tokens / total
    for _ in range(ROUNDS):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            held = np.bincount(code, weights=w, minlength=len(goal))
            off = max(off, float(np.abs(held - goal).max()))
            w = w * np.divide(goal, held, out=np.zeros_like(goal), where=held > 0)[code]
        if off < 1e-12:
            break
    return w * total


def _filled(parts: np.ndarray, caps: np.ndarray, target: float) -> np.ndarray:
    """``parts`` times one factor, none above its cap, so that they add up to ``target`` or to all the caps."""
    used = parts > 0
    if target >= caps[used].sum():
        return np.where(used, caps, 0.0)
    order = np.argsort(np.divide(caps, parts, out=np.full(len(parts), np.inf), where=used))
    p, c = parts[order][: used.sum()], caps[order][: used.sum()]
    held = np.concatenate([[0.0], np.cumsum(c)[:-1]])  # what the full ones before have
    factor = (target - held) / np.cumsum(p[::-1])[::-1]
    k = int(np.argmax(factor * p <= c))
    return np.minimum(caps, parts * max(factor[k], 0.0))


def capped(cells: list[tuple], tokens: np.ndarray, targets: list[dict | None], budget: float, temperature: float = TEMPERATURE) -> np.ndarray:
    """Tokens to take from each cell, at most all it has: proportional fitting with every step filled up to the caps."""
    total = tokens.sum()
    if not len(cells) or total == 0:
        return tokens.astype(float)
    codes, goals = _goals(cells, tokens, targets, temperature)
    size = min(budget, 1.0) * total
    wanted = [_filled(goal * size, np.bincount(code, weights=tokens, minlength=len(goal)), size) for code, goal in zip(codes, goals, strict=True)]
    members = [[np.flatnonzero(code == k) for k in range(len(goal))] for code, goal in zip(codes, goals, strict=True)]
    take = tokens * (size / total)
    for _ in range(ROUNDS):
        off = 0.0
        for which, want in zip(members, wanted, strict=True):
            for at, target in zip(which, want, strict=True):
                off = max(off, abs(take[at].sum() - target))
                take[at] = _filled(take[at], tokens[at], target)
        if off < 1e-9 * total:
            break
    return take


def mixed(docs: DataFrame, dims: dict[str, Column], targets: dict[str, dict] | None = None, seed: int = 17, tokens: Column | None = None, budget: float | None = None, repeats: bool = True) -> DataFrame:
    """``docs`` with the dims' categories (``_dim_*``), _tokens, _weight, _probability, _copies and _sampled (any copy)."""
    names = list(dims)
    counted = docs.withColumn("_tokens", token_count() if tokens is None else tokens)
    counted = counted.withColumns({f"_dim_{n}": F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in dims.items()})
    keys = [f"_dim_{n}" for n in names]
    rows = counted.groupBy(*keys).agg(F.sum("_tokens").alias("t")).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; use coarser categories")
    held = np.array([r["t"] for r in rows], float)
    cells = [tuple(r[k] for k in keys) for r in rows]
    goals = [(targets or {}).get(n) for n in names]
    raked = rake(cells, held, goals) if repeats or budget is None else capped(cells, held, goals, budget) / min(budget, 1.0)
    weight = np.divide(raked, held, out=np.zeros_like(held), where=held > 0)
    top = max(weight.max(), 1e-300) if len(rows) else 1.0
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField("_weight", T.DoubleType()), T.StructField("_expected", T.DoubleType())])
    table = [(*c, float(w), float(w / top if budget is None else w * budget if repeats else min(1.0, w * min(budget, 1.0))) if t > 0 else 1.0) for c, w, t in zip(cells, weight, held, strict=True)]
    cell = docs.sparkSession.createDataFrame(table, schema)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor("_expected")
    copies = (whole + F.when(draw < F.col("_expected") - whole, 1).otherwise(0)).cast("long")
    out = counted.join(F.broadcast(cell), keys).withColumns({"_probability": F.least(F.lit(1.0), F.col("_expected")), "_copies": copies})
    return out.withColumn("_sampled", F.col("_copies") > 0).drop("_expected")


def dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of()}


def draw_mixture(docs: DataFrame, budget: float = KEEP) -> DataFrame:
    """A sample without repeats of about ``budget`` of the tokens, with the columns of ``docs``."""
    return mixed(docs, dimensions(), budget=budget, repeats=False).where("_sampled").select(*(f"`{c}`" for c in docs.columns))
