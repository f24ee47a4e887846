"""Substring dedup: suffix automata of reference shards give matching statistics; repeated spans are removed.

A window is ``WINDOW`` consecutive words of one text.  Every word covered by a window whose word sequence also
starts anywhere else (same text included) is removed.  Comparing each text with automata of the whole corpus
would be quadratic, so the corpus is cut into shards in which all equal windows meet:

1. ``anchors``: a window's anchor is its smallest ``GRAM``-word hash (the leftmost of equals).  Equal windows
   have equal anchors.  Consecutive windows with one anchor are one passage, and each window is in exactly one.
2. Passages whose anchor occurs once can't repeat and are left out; the others are read from their texts.
3. The passages of one anchor are a reference shard of bounded size.  Instead of a broadcast that would grow
   with the corpus, shard and passages meet in one task, which builds the shard's automaton with occurrence
   counts and streams the passages through it: at each word the state of the last ``WINDOW`` words tells how
   often they occur.  Equal passages are entered once, with their number.
4. An anchor with more than ``HOT`` passages would be an unbounded shard.  Its windows are shards of their own,
   named by 128-bit digests: a block of texts that has one twice knows that it repeats, and sends one digest on
   behalf of all.
5. Repeated windows go back to their texts, where their union is removed.

Words and windows are compared by 64-bit hashes.  Null and empty texts have no words and keep the empty text;
repeated rows are texts that repeat each other; ``doc_id`` may be null or repeat; extra columns are ignored; an
empty table gives an empty result.  The table must be a stored one (see words.with_row_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import Words, blocks, run_hashes, with_row_id, words_of
from tickloom.session import cut

WINDOW = 35
GRAM = 8
HOT = 1024
DIGEST = 16  # bytes


def window_anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start (in words of the whole block) of every passage."""
    n = len(words.hashes) - gram + 1
    starts, _ = words.windows(window)
    if n <= 0 or not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    h = run_hashes(words.hashes, at, at + gram, 0xC2B2AE3D27D4EB4F)
    span = window - gram + 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] < h[a], b, a)

    best, covered = at, 1
    while covered * 2 <= span:
        best = lower(best[:-covered], best[covered:])
        covered *= 2
    if covered < span:
        best = lower(best[: len(best) - (span - covered)], best[span - covered :])
    best = best[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)
    edge = np.flatnonzero(new)
    return h[best[edge]], starts[edge], starts[np.append(edge[1:], len(starts)) - 1]


def anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, _rid, lo, hi): the passages of each text, by their first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = words_of(batch.column("text"))
            anchor, lo, hi = window_anchors(words, window, gram)
            doc = words.doc[lo]
            base = words.first[doc]
            rid = batch.column("_rid").to_numpy(zero_copy_only=False)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(rid), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], ["anchor", "_rid", "lo", "hi"])

    return cut(rows.select("_rid", "text").mapInArrow(run, "anchor long, _rid long, lo int, hi int"))


_PASSAGE = "key long, _rid long, lo int, hi int, words binary"


def _passages(window: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = words_of(batch.column("text"))
            rids = batch.column("_rid").to_numpy(zero_copy_only=False)
            key, rid, lo, hi, body = [], [], [], [], []
            hits = batch.column("hits")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy()))
            flat = hits.flatten()
            anchor, first, last, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "lo", "hi", "n"))
            base = words.first[doc]
            for i in np.flatnonzero(n <= hot):
                key.append(int(anchor[i]))
                rid.append(int(rids[doc[i]]))
                lo.append(int(first[i]))
                hi.append(int(last[i]))
                body.append(words.hashes[base[i] + first[i] : base[i] + last[i] + window])
            many = n > hot
            if many.any():
                length = (last - first + 1)[many]
                ends = np.cumsum(length)
                start = np.arange(ends[-1]) - np.repeat(ends - length, length) + np.repeat(first[many], length)
                d, b = np.repeat(doc[many], length), np.repeat(base[many], length)
                w = run_hashes(words.hashes, b + start, b + start + window, 0xA24BAED4963EE407).view(np.int64)
                second = run_hashes(words.hashes, b + start, b + start + window, 0xD6E8FEB86659FD93)
                kind, where, count = np.unique(w, return_inverse=True, return_counts=True)
                local = count[where] > 1
                one = np.zeros(len(kind), np.int64)
                one[where] = np.arange(len(w))
                # Repeated within the block: known already; one copy without a row speaks for all.
                for i in np.concatenate([np.flatnonzero(~local), one[count > 1]]):
                    key.append(int(w[i]))
                    rid.append(-1 if local[i] else int(rids[d[i]]))
                    lo.append(int(start[i]))
                    hi.append(int(start[i]))
                    body.append(np.array([w[i], second[i].view(np.int64)]))  # a digest instead of the words
                known = np.flatnonzero(local)
                order = known[np.lexsort((start[known], d[known]))]
                if len(order):
                    new = np.ones(len(order), bool)
                    new[1:] = (d[order][1:] != d[order][:-1]) | (start[order][1:] != start[order][:-1] + 1)
                    edge = np.flatnonzero(new)
                    for a, z in zip(order[edge], order[np.append(edge[1:], len(order)) - 1], strict=True):
                        key.append(int(rids[d[a]]))
                        rid.append(int(rids[d[a]]))
                        lo.append(int(start[a]))
                        hi.append(int(start[z]))
                        body.append(None)
            binary = pa.array([None if x is None else x.tobytes() for x in body], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(rid, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), binary], ["key", "_rid", "lo", "hi", "words"])

    return run


class Automaton:
    """Suffix automaton of several word sequences; counts how often each substring occurs in them."""

    def __init__(self, sequences: list[list[int]], times: list[int]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for sequence, n in zip(sequences, times, strict=True):
            state = 0
            for word in sequence:
                state = self._extend(state, word)
                self.count[state] += n
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _split(self, state: int, word: int) -> int:
        """The state of exactly ``state``'s longest string and ``word``."""
        target = self.step[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        self.step.append(dict(self.step[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.count.append(0)
        copy = len(self.link) - 1
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, state: int, word: int) -> int:
        if word in self.step[state]:
            return self._split(state, word)
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[state] + 1)
        self.count.append(0)
        new = len(self.link) - 1
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def occurrences(self, sequence: list[int], size: int) -> list[int]:
        """How often each run of ``size`` words of an entered sequence occurs."""
        out, state, matched = [], 0, 0
        for word in sequence:
            state, matched = self.step[state][word], matched + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= size:
                state = self.link[state]
            if matched >= size:
                out.append(self.count[state])
        return out


def repeated_windows(passages: list[tuple[int, int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """(row, first, last window) of the passages (row, lo, hi, words) of one shard that repeat; row -1: at least two."""
    by_text: dict[bytes, list[tuple[int, int, int]]] = {}
    for rid, lo, hi, body in passages:
        by_text.setdefault(body, []).append((rid, lo, hi))
    times = [sum(2 if rid < 0 else 1 for rid, _, _ in held) for held in by_text.values()]
    if len(passages[0][3]) == DIGEST:  # a window of a hot anchor
        return [p for held, n in zip(by_text.values(), times, strict=True) if n > 1 for p in held if p[0] >= 0]
    if len(by_text) == 1:
        return [p for p in next(iter(by_text.values())) if p[0] >= 0] if times[0] > 1 else []
    sequences = [np.frombuffer(body, np.uint64).tolist() for body in by_text]
    automaton = Automaton(sequences, times)
    out = []
    for sequence, held in zip(sequences, by_text.values(), strict=True):
        again = np.concatenate([[0], np.array(automaton.occurrences(sequence, window)) > 1, [0]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(again))
        for a, z in zip(edge[::2], edge[1::2], strict=True):
            out += [(rid, lo + int(a), lo + int(z) - 1) for rid, lo, _ in held if rid >= 0]
    return out


def _shards(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key's rows may run over several batches."""
        current, held = None, []
        for batch in batches:
            out = []
            for key, rid, lo, hi, body in zip(*(batch.column(c).to_pylist() for c in ("key", "_rid", "lo", "hi", "words")), strict=True):
                if body is None:
                    out.append((rid, lo, hi))
                    continue
                if key != current:
                    out += repeated_windows(held, window) if len(held) > 1 else []
                    current, held = key, []
                held.append((rid, lo, hi, body))
            yield _found(out)
        yield _found(repeated_windows(held, window) if len(held) > 1 else [])

    return run


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["_rid", "lo", "hi"])


_KEPT = "_rid long, doc_id long, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept string"


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = words_of(batch.column("text"))
            count = words.counts()
            change = np.zeros(len(words.hashes) + 1, np.int64)
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                for s in spans or ():
                    change[words.first[i] + s["lo"]] += 1
                    change[words.first[i] + s["hi"] + window] -= 1
            gone = np.cumsum(change[:-1]) > 0
            keep = np.flatnonzero(~gone)
            # Kept words, each with a space before it that the first one of a text drops.
            length = (words.end - words.start)[keep] + 1
            ends = np.cumsum(length)
            source = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(words.start[keep] - 1, length)
            body = words.data[np.maximum(source, 0)]
            body[ends - length] = 32
            of = np.searchsorted(words.doc[keep], np.arange(batch.num_rows + 1))
            at = np.concatenate([[0], ends])[of]
            raw = body.tobytes()
            texts = [raw[a + 1 : z] if z > a else b"" for a, z in zip(at[:-1], at[1:], strict=True)]
            removed = np.bincount(words.doc[gone], minlength=batch.num_rows)
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            new = gone.copy()
            new[1:] &= ~gone[:-1] | (words.doc[1:] != words.doc[:-1])
            first = np.flatnonzero(new)
            stop = np.searchsorted(np.flatnonzero(edge < 0), first, side="right")
            last = np.minimum(np.flatnonzero(edge < 0)[stop], words.first[words.doc[first] + 1]) - 1 if len(first) else first
            owner = words.doc[first]
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            base = words.first[owner]
            pairs = pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["first", "last"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_rid"), batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pairs), pa.array(texts, pa.binary()).cast(pa.string())],
                ["_rid", "doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): _rid, doc_id, n_words, n_removed, the removed spans of words, kept text."""
    rows = with_row_id(docs).select("_rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = anchors(rows, window, gram)
    # Stored, so that a hot anchor's partition can be split when the passages are joined with it.
    several = cut(placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    hits = placed.join(several.hint("merge"), "anchor").groupBy("_rid").agg(F.collect_list(F.struct("anchor", "lo", "hi", "n")).alias("hits"))
    # Both joins with the texts share one shuffle of them.
    passages = rows.join(hits.hint("merge"), "_rid").select("_rid", "doc_id", "text", "hits").mapInArrow(_passages(window, hot), _PASSAGE)
    found = passages.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(window), "_rid long, lo int, hi int")
    spans = found.groupBy("_rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return rows.join(spans.hint("merge"), "_rid", "left").select("_rid", "doc_id", "text", "spans").mapInArrow(_kept(window), _KEPT)
