"""Quality classifier: a sparse ensemble of tree-path rules over text statistics.

``statistics`` are computed on whole texts in numpy.  A random forest of shallow trees is fitted on all labelled
rows; every path from a root to a node is a conjunctive rule.  A lasso logistic regression picks and weights the
rules, and the chosen ones are compiled into one Spark column expression.  Rules are bounded by
``TREES * 2^(DEPTH + 1)``; only trees and weights reach the driver.

Labels that disagree about a doc_id count by their mean; null labels are left out.  Without labels of both kinds
the score is the share of good labels, or 0.5 without any.  Null and empty texts have zero statistics and are
scored like others.  Repeated rows are scored alike; extra columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import blocks, run_hashes, text_bytes, words_of
from tickloom.session import cut

TREES, DEPTH = 20, 3
LASSO = 1e-3
PART_ROWS = 20_000  # training rows in a partition
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "word_spread", "longest_word", "digits", "upper", "points", "symbols", "bars", "other",
    "distinct_words", "repeated_next", "symbol_words", "long_words", "log_lines", "line_words", "distinct_lines",
]

_KIND = np.full(256, 6)
_KIND[[*range(48, 58)]] = 0
_KIND[[*range(65, 91)]] = 1
_KIND[[*b".,;:!?'\"()-"]] = 2
_KIND[[*b"#$%&*+/<=>@[\\]^_`{}~"]] = 3
_KIND[ord("|")] = 4
_KIND[[*range(0, 9), *range(14, 32), 127]] = 5


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, off = text_bytes(texts)
    n, size = len(texts), np.diff(off)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 7 + _KIND[data], minlength=7 * n).reshape(n, 7)
    w = words_of(texts)
    count, length = w.counts(), (w.end - w.start).astype(float)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=values, minlength=n) / np.maximum(count, 1)

    mean = per_word(length)
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    pairs = np.sort((w.doc.astype(np.uint64) << np.uint64(44)) | (w.hashes >> np.uint64(20)))
    fresh = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    distinct = np.bincount((fresh >> np.uint64(44)).astype(np.int64), minlength=n)
    again = np.zeros(len(w.hashes))
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    marks = np.concatenate([[0], np.cumsum(np.isin(_KIND[data], (3, 4)))])
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1][size > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    line_doc = np.searchsorted(off, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), off[line_doc + 1])
    lines = np.bincount(line_doc, minlength=n)
    kept = np.unique((line_doc.astype(np.uint64) << np.uint64(44)) | (run_hashes(data, starts, ends, 0x9E3779B97F4A7C15) >> np.uint64(20)))
    distinct_lines = np.bincount((kept >> np.uint64(44)).astype(np.int64), minlength=n)
    share = kinds / np.maximum(size, 1)[:, None]
    return np.column_stack([
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), longest, share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5],
        distinct / np.maximum(count, 1), per_word(again), per_word((marks[w.end] > marks[w.start]).astype(float)), per_word((length > 20).astype(float)),
        np.log1p(lines), count / np.maximum(lines, 1), distinct_lines / np.maximum(lines, 1),
    ])


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _stats, an array of doubles in the order of STATISTICS."""

    @F.arrow_udf("array<double>")
    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = [statistics(b.column("text")) for b in blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]))]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            at = np.arange(len(flat) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(flat.ravel()))

    return docs.withColumn("_stats", compute.asNondeterministic()(F.col(text).cast("string")))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most or above, threshold), sorted


@dataclass
class RuleEnsemble:
    rules: list[tuple[Rule, float]]
    linear: list[float]
    low: list[float]
    high: list[float]
    intercept: float

    def describe(self) -> list[str]:
        return [f"{weight:+.3f} if " + " and ".join(f"{STATISTICS[i]} {'<=' if below else '>'} {t:.4g}" for i, below, t in rule) for rule, weight in self.rules]


def _paths(tree) -> set[Rule]:
    """Conjunctions that lead to each node but the root."""
    out: set[Rule] = set()
    todo = [(tree._java_obj.rootNode(), {})]
    while todo:
        node, bounds = todo.pop()
        if bounds:
            out.add(tuple(sorted((i, below, t) for (i, below), t in bounds.items())))
        if "Internal" in node.getClass().getSimpleName():
            i, t = node.split().featureIndex(), node.split().threshold()
            for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
                old = bounds.get((i, below), t)
                todo.append((child, bounds | {(i, below): min(old, t) if below else max(old, t)}))
    return out


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (F.col("_stats")[i] <= t if below else F.col("_stats")[i] > t for i, below, t in rule))


def _scaled(i: int, low: float, high: float) -> Column:
    """A statistic within its middle range, from 0 to 1."""
    return F.least(F.greatest((F.col("_stats")[i] - low) / (high - low), F.lit(0.0)), F.lit(1.0)) if high > low else F.lit(0.0)


def fit_rules(rows: DataFrame, seed: int = 5) -> RuleEnsemble:
    """Fit on all rows of (_stats, label: 0 or 1)."""
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    width = len(STATISTICS)
    if not n or good in (0, n):
        rate = min(max((good or 0) / n, 1e-6), 1 - 1e-6) if n else 0.5
        return RuleEnsemble([], [0.0] * width, [0.0] * width, [0.0] * width, math.log(rate / (1 - rate)))
    train = cut(rows.select("_stats", F.col("label").cast("double").alias("label")).repartition(math.ceil(n / PART_ROWS)))
    ranges = train.agg(*(F.percentile_approx(F.col("_stats")[i], [0.025, 0.975], 1000).alias(f"q{i}") for i in range(width))).first()
    low, high = [float(q[0]) for q in ranges], [float(q[1]) for q in ranges]
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, featureSubsetStrategy="0.5", minInstancesPerNode=10, seed=seed)
    model = forest.fit(train.select("label", array_to_vector("_stats").alias("features")))
    rules = sorted(set().union(*(_paths(t) for t in model.trees)))
    terms = [_holds(r).cast("double") for r in rules] + [_scaled(i, low[i], high[i]) for i in range(width)]
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
    fitted = lasso.fit(train.select("label", array_to_vector(F.array(*terms)).alias("features")))
    weights = [float(w) for w in fitted.coefficients.toArray()]
    chosen = [(r, w) for r, w in zip(rules, weights[: len(rules)], strict=True) if w]
    return RuleEnsemble(chosen, weights[len(rules) :], low, high, float(fitted.intercept))


def score_column(model: RuleEnsemble) -> Column:
    """Probability that the label is 1, as an expression over _stats."""
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        total = total + F.when(_holds(rule), weight).otherwise(0.0)
    for i, weight in enumerate(model.linear):
        if weight:
            total = total + _scaled(i, model.low[i], model.high[i]) * weight
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, least: float = 0.7) -> DataFrame:
    """``docs`` without its text, with held_out, score and predicted; learns from labelled rows not held out."""
    stats = cut(with_statistics(docs.withColumn("held_out", held_out)).drop("text"))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    model = fit_rules(stats.where("NOT held_out").select("doc_id", "_stats").join(known, "doc_id"))
    out = stats.withColumn("score", score_column(model)).drop("_stats")
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))
