"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased per character, every run of non-letters becomes one space, and all n-grams of one to
three characters are hashed into ``BUCKETS`` buckets.  ``fit_languages`` counts the n-grams of every training
row (no sample); counts are added up per (language, bucket) before and after the shuffle, so what reaches the
driver is one row for each such pair: at most ``MAX_LANGUAGES * BUCKETS``.  The log-probability matrix has the
same bound (32 MB) and is broadcast.  Scoring gathers it per block of texts in numpy.

A text that is null or has no letter is ``und`` with score 0, as is every text when there was nothing to
learn from.  Languages that tie go to the alphabetically first.  Repeated rows count as often as they occur.
Extra columns stay; ``lang_pred`` and ``score`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import blocks, text_bytes

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 256
SMOOTHING = 0.5
UNDETERMINED = "und"
_SPACE = 32
_FOLDED: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For each character of the basic plane its lower-case form, or a space if it is no letter."""
    if not _FOLDED:
        out = np.full(1 << 16, _SPACE, np.uint32)
        for cp in range(1 << 16):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                out[cp] = ord(low) if len(low) == 1 else cp
        _FOLDED.append(out)
    return _FOLDED[0]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts with single spaces between words, and the text of each."""
    data, off = text_bytes(texts)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    cp = padded[at]
    wide = np.flatnonzero(cp >= 0xC0)
    b0, p = cp[wide], at[wide]
    b1, b2, b3 = (padded[p + k] & 0x3F for k in (1, 2, 3))
    two, three = (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2
    cp[wide] = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    folded = _fold_table()[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        kinds, which = np.unique(cp[far], return_inverse=True)
        folded[far] = np.array([c if c < 0x110000 and chr(c).isalpha() else _SPACE for c in kinds.tolist()], np.uint32)[which]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(at, off)))
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != _SPACE) | (folded[:-1] != _SPACE) | (doc[1:] != doc[:-1])
    return folded[keep], doc[keep]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram, and which texts have a letter."""
    chars, doc = characters(texts)
    letters = np.bincount(doc[chars != _SPACE], minlength=len(texts)) > 0
    buckets, docs = [], []
    for order in ORDERS:
        m = max(0, len(chars) - order + 1)
        h = np.full(m, order, np.uint32)
        for k in range(order):
            h = (h ^ chars[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        ok = doc[:m] == doc[order - 1 : order - 1 + m]
        if order == 1:
            ok &= chars != _SPACE
        buckets.append((h >> np.uint32(32 - BITS))[ok])
        docs.append(doc[:m][ok])
    return np.concatenate(buckets), np.concatenate(docs), letters


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # languages x BUCKETS
    prior: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in blocks(batches):
        names, which = np.unique(batch.column("lang").to_numpy(zero_copy_only=False), return_inverse=True)
        bucket, doc, letters = grams(batch.column("text"))
        of = which[doc]
        for k, name in enumerate(names):
            held = counts.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
            held[:BUCKETS] += np.bincount(bucket[of == k], minlength=BUCKETS)
            held[BUCKETS] += int((letters & (which == k)).sum())  # texts, for the prior
    for name, held in counts.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "bucket", "n"])


def fit_languages(rows: DataFrame) -> LanguageModel:
    """Learn from all rows of (text, lang) with a lang."""
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    table = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, which = np.unique(np.asarray(table.column("lang").to_pylist(), object), return_inverse=True)
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the broadcast matrix is bounded at {MAX_LANGUAGES}")
    counts = np.zeros((len(names), BUCKETS + 1))
    counts[which, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    smooth = counts[:, :BUCKETS] + SMOOTHING
    logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(names) else smooth
    texts = counts[:, BUCKETS] + 1
    return LanguageModel(list(names), logp.astype(np.float32), np.log(texts / max(1, texts.sum())))


def score_texts(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    bucket, doc, letters = grams(texts)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    total = np.stack([p + np.bincount(doc, weights=row[bucket], minlength=len(texts)) for row, p in zip(model.logp, model.prior, strict=True)])
    best = total.argmax(axis=0)
    posterior = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], np.where(letters, posterior, 0.0)


def language_column(model: LanguageModel, df: DataFrame, text: str = "text") -> Column:
    """Struct (lang_pred, score) of each row's text."""
    # Plain lists and arrays: broadcasts are unpickled where this package may not be installed.
    shared = df.sparkSession.sparkContext.broadcast((list(map(str, model.languages)), model.logp, model.prior))

    @F.arrow_udf("lang_pred string, score double")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LanguageModel(*shared.value)
        for column in columns:
            names, scores = [], [np.zeros(0)]
            for block in blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])])):
                got, score = score_texts(block.column("text"), model)
                names += got
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return predict.asNondeterministic()(F.col(text).cast("string"))  # one evaluation a row, also above filters


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score."""
    found = docs.withColumn("_found", language_column(model, docs))
    return found.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a row belongs to the fold that nothing is learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose text is in one of the learned languages with at least ``least`` probability."""
    found = docs.withColumn("_found", language_column(model, docs))
    return found.where((F.col("_found.lang_pred") != UNDETERMINED) & (F.col("_found.score") >= least)).drop("_found")
