"""N-gram Jaccard join: sets in one global order, kept in prefix trees and matched without building pairs.

A text's set holds its distinct five-word shingles; a text with fewer words has its whole word sequence as
one shingle; a text without words (or null) has an empty set and links with nothing.  Two rows link when
100 * |A and B| >= 75 * |A or B|.  The steps:

1. ``profiles``: one pass over the texts sends each shingle (32 bits of it, within a hash range) to the task
   of its range, which answers how many sets hold it.  A set can link only if at least 3/4 of it also
   occurs elsewhere, so most texts are ruled out here without being compared with anything.
2. Equal sets are one class from here on: copies are never paired.
3. ``ordered_sets``: the remaining sets list their shared shingles from rare to frequent.  Linked sets share
   one of the first ``s - ceil(0.75 n) + 1`` of them.
4. ``tree_blocks``: all sets that hold a given prefix shingle go where the smallest of them leads.  Large
   blocks are split over a grid of tasks, so no task gets an unbounded block.
5. ``trie_links``: a task keeps its sets in a radix tree.  A probe walks the tree level by level; the overlap
   of a node's path is shared by all sets below it, and a subtree is left when the tokens that remain can't
   reach the needed overlap.  Sets already connected are skipped, so a task returns at most one edge a set.
6. Components of these edges give each row the smallest doc_id it can reach.

Other cases: repeated rows are copies; a null doc_id never is a component's smallest unless all are null;
an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import component_labels, salted_join
from tickloom.llm.words import blocks, packed, with_row_id, words_of
from tickloom.session import cut

WIDTH = 5
NUM, DEN = 3, 4  # similarity of 0.75 as a ratio, so that comparisons are exact
RANGE_TOKENS = 1 << 20  # shingles that one counting group should get
BLOCK_SETS = 4096  # sets in one task's tree


def shingle_tokens(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as sorted (text << 48 | 48-bit hash), and the size of each text's set."""
    words = words_of(texts, fold=True)
    starts, hashes = words.windows(width)
    count = words.counts()
    short = np.flatnonzero((count > 0) & (count < width))
    doc = np.concatenate([words.doc[starts], short]).astype(np.uint64)
    all_hashes = np.concatenate([hashes, words.whole(short)])
    keys = np.sort((doc << np.uint64(48)) | (all_hashes >> np.uint64(16)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    size = np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(texts))
    return keys, size


def _digests(keys: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums over each set: equal sets have equal sums."""
    token = keys & np.uint64((1 << 48) - 1)
    edge = np.concatenate([[0], np.cumsum(size)])
    out = []
    for odd in (0x9E3779B97F4A7C15, 0xA24BAED4963EE407):
        x = token * np.uint64(odd)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(32)))])
        out.append((sums[edge[1:]] - sums[edge[:-1]]).astype(np.int64))
    return out[0], out[1]


_SENT = "range long, block long, body binary"


def _send(width: int, bits: int):
    """Per block of texts: a message for each hash range, and one (range -1) about the texts themselves.

    A shingle that several texts of the block hold is sent once, with their number; the block's own message says
    which of its entries follow which other one.  So a very common shingle is one entry a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rid = batch.column("_rid").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            keys, size = shingle_tokens(batch.column("text"), width)
            d1, d2 = _digests(keys, size)
            # Only the first of equal sets in the block speaks for them.
            first = ~pd.DataFrame({"n": size, "a": d1, "b": d2}).duplicated().to_numpy() & (size > 0)
            about = [rid, size, d1, d2, first, ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)]
            keys = keys[first[(keys >> np.uint64(48)).astype(np.int64)]]
            token = keys & np.uint64((1 << 48) - 1)
            order = np.argsort(token, kind="stable")
            ordered = token[order]
            lead = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
            starts = np.flatnonzero(lead)
            copies = np.diff(np.append(starts, len(ordered)))
            followers, leaders = order[~lead], np.repeat(order[starts], copies - 1)
            doc = (keys[order[starts]] >> np.uint64(48)).astype(np.uint16)
            head = np.array([len(size), len(doc), len(followers)], np.uint32).tobytes()
            own = head + np.stack([np.asarray(x, np.int64) for x in about]).tobytes() + doc.tobytes() + followers.astype(np.uint32).tobytes() + leaders.astype(np.uint32).tobytes()
            ranges, bodies = [-1], [own]
            part = (ordered[starts] >> np.uint64(48 - bits)).astype(np.int64)
            low = ((ordered[starts] << np.uint64(bits) >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cut_at = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip([0, *cut_at], [*cut_at, len(part)], strict=True):
                if hi > lo:
                    several = np.flatnonzero(copies[lo:hi] > 1)
                    ranges.append(int(part[lo]))
                    bodies.append(np.concatenate([[hi - lo], low[lo:hi], several, copies[lo:hi][several] - 1]).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array([int(rid[0])] * len(ranges), pa.int64()), pa.array(bodies, pa.binary())], ["range", "block", "body"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """One hash range: answer every message with each shingle's level, 0 if no other set has it."""
    if table.num_rows == 0 or table.column("range")[0].as_py() < 0:
        return table
    tokens, weights = [], []
    for body in table.column("body").to_pylist():
        words = np.frombuffer(body, np.uint32)
        n, more = int(words[0]), (len(words) - 1 - int(words[0])) // 2
        weight = np.ones(n, np.int64)
        weight[words[1 + n : 1 + n + more]] += words[1 + n + more :]
        tokens.append(words[1 : 1 + n])
        weights.append(weight)
    flat = np.concatenate(tokens)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    df = np.add.reduceat(np.concatenate(weights)[order], edge)
    level = np.empty(len(flat), np.uint8)
    level[order] = np.repeat(np.log2(df).astype(np.uint8), np.diff(np.append(edge, len(flat))))
    ends = np.cumsum([len(t) for t in tokens])
    out = [level[e - len(t) : e].tobytes() for t, e in zip(tokens, ends, strict=True)]
    return table.set_column(table.schema.get_field_index("body"), "body", pa.array(out, pa.binary()))


_PROFILE = "_rid long, doc_id long, n long, d1 long, d2 long, levels binary"


def _profile(table: pa.Table) -> pa.Table:
    """One block of texts: sizes and digests, and the levels of sets that can link at all."""
    rows = sorted(zip(table.column("range").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda r: r[0])
    own = rows[0][1]
    head, sent, after = (int(x) for x in np.frombuffer(own, np.uint32, 3))
    at = 12 + 56 * head
    rid, n, d1, d2, first, valid, ids = np.frombuffer(own, np.int64, 7 * head, 12).reshape(7, head)
    doc = np.frombuffer(own, np.uint16, sent, at)
    followers, leaders = np.frombuffer(own, np.uint32, 2 * after, at + 2 * sent).reshape(2, after)
    size = np.where(first == 1, n, 0)
    edge = np.concatenate([[0], np.cumsum(size)])
    # Answers come in the order of the hashes; entries are wanted text by text.
    level = np.zeros(edge[-1], np.uint8)
    sending = np.ones(edge[-1], bool)
    sending[followers] = False
    answers = np.frombuffer(b"".join(b for _, b in rows[1:]), np.uint8)
    level[sending] = answers[np.argsort(doc, kind="stable")]
    level[followers] = level[leaders]
    shared = np.bincount(np.repeat(np.arange(head), size)[level > 0], minlength=head)
    levels: list[bytes | None] = [None] * head
    for i in np.flatnonzero((size > 0) & (DEN * shared >= NUM * n)):
        levels[i] = level[edge[i] : edge[i + 1]].tobytes()
    doc_id = pa.array([int(v) if ok else None for v, ok in zip(ids, valid, strict=True)], pa.int64())
    return pa.table([pa.array(rid), doc_id, pa.array(n), pa.array(d1), pa.array(d2), pa.array(levels, pa.binary())], ["_rid", "doc_id", "n", "d1", "d2", "levels"])


def profiles(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of (_rid, doc_id, text): set size n, digests d1 and d2, and levels (null: can't link)."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(32, max(4, int(total / 6 / RANGE_TOKENS).bit_length()))  # the rest of a shingle's 48 bits is sent
    sent = rows.select("_rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_send(width, bits), _SENT)
    # Messages about the texts are dealt by block; the others are dealt by range.
    group = F.when(F.col("range") < 0, -1 - F.pmod(F.xxhash64("block"), F.lit(1 << bits))).otherwise(F.col("range"))
    counted = sent.withColumn("group", group).groupBy("group").applyInArrow(lambda t: _count(t.drop_columns(["group"])), _SENT)
    return cut(counted.groupBy("block").applyInArrow(_profile, _PROFILE))


_SET = "_rid long, n long, s long, tokens binary, prefix array<long>"


def _ordered(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            keys, size = shingle_tokens(batch.column("text"), width)
            edge = np.concatenate([[0], np.cumsum(size)])
            sets, shared, prefixes = [], [], []
            for i, levels in enumerate(batch.column("levels").to_pylist()):
                level = np.frombuffer(levels, np.uint8)
                token = keys[edge[i] : edge[i + 1]] & np.uint64((1 << 48) - 1)
                ordered = np.sort((level.astype(np.uint64) << np.uint64(48) | token)[level > 0])
                need = -(-NUM * int(size[i]) // DEN)
                sets.append(ordered)
                shared.append(len(ordered))
                prefixes.append(ordered[: len(ordered) - need + 1].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_rid"), pa.array(size.astype(np.int64)), pa.array(shared, pa.int64()), packed(sets), pa.array(prefixes, pa.list_(pa.int64()))],
                ["_rid", "n", "s", "tokens", "prefix"],
            )

    return run


def ordered_sets(rows: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """The wanted rows' shared shingles, rare to frequent, and the prefix that a linked set must touch."""
    return cut(rows.select("_rid", "text").join(wanted.select("_rid", "levels"), "_rid").mapInArrow(_ordered(width), _SET))


class Trie:
    """A radix tree over token sequences in one global order; each node keeps the run of tokens on its edge."""

    def __init__(self, sequences: list[np.ndarray], n: np.ndarray):
        self.rank, flat = np.unique(np.concatenate(sequences), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sequences])])
        ranked = [flat[a:b].astype(">u4") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.order = np.array(sorted(range(len(ranked)), key=lambda i: ranked[i].tobytes()), np.int64)
        self.sets = [ranked[i].astype(np.int64) for i in self.order]
        self.n = n[self.order]
        self._build()

    def _build(self) -> None:
        # Leaves are in lexicographic order, so each node covers a range of them.
        edges, spans, self.children, self.depth, last = [], [], [], [], []

        def node(leaf: int, frm: int, to: int) -> int:
            edges.append(self.sets[leaf][frm:to])
            spans.append([leaf, leaf + 1])
            self.children.append([])
            self.depth.append(to)
            return len(edges) - 1

        path = [node(0, 0, 0)]
        for leaf, tokens in enumerate(self.sets):
            common = 0
            if leaf:
                prev = self.sets[leaf - 1]
                m = min(len(prev), len(tokens))
                differ = np.flatnonzero(prev[:m] != tokens[:m])
                common = int(differ[0]) if len(differ) else m
            while self.depth[path[-1]] > common:
                top = path.pop()
                spans[top][1] = leaf
                if self.depth[path[-1]] < common:  # split the edge at the common length
                    upper = len(edges)
                    at = common - self.depth[path[-1]]
                    edges.append(edges[top][:at])
                    edges[top] = edges[top][at:]
                    spans.append([spans[top][0], leaf])
                    self.children.append([top])
                    self.depth.append(common)
                    self.children[path[-1]][-1] = upper
                    path.append(upper)
            new = node(leaf, common, len(tokens))
            self.children[path[-1]].append(new)
            last.append(new)
            path.append(new)
        for top in path:
            spans[top][1] = len(self.sets)
        self.is_leaf = np.full(len(edges), -1)
        self.is_leaf[last] = np.arange(len(last))
        self.span = np.array(spans)
        self.depth = np.array(self.depth)
        self.edge_len = np.array([len(e) for e in edges])
        self.edge_at = np.concatenate([[0], np.cumsum(self.edge_len)])
        self.edge = np.concatenate(edges)
        self.child_n = np.array([len(c) for c in self.children])
        self.child_at = np.concatenate([[0], np.cumsum(self.child_n)])
        self.child = np.array([c for cs in self.children for c in cs], np.int64)
        size = np.array([len(s) for s in self.sets])
        self.longest = np.array([size[a:b].max() for a, b in self.span])
        self.smallest = np.array([self.n[a:b].min() for a, b in self.span])

    def _ranges(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        ends = np.cumsum(length)
        return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(at, length)

    def linked(self, tokens: np.ndarray, n: int, wanted: np.ndarray) -> np.ndarray:
        """Leaves among ``wanted`` (a mask) that link with a set of ``n`` shingles whose ranks are ``tokens``."""
        has = np.zeros(len(self.rank) + 1, np.int64)
        has[tokens] = 1
        left = np.concatenate([[0], np.cumsum(has)])  # tokens of the probe before a rank
        alive = np.concatenate([[0], np.cumsum(wanted)])
        nodes, overlap, found = np.array([0]), np.array([0]), []
        while len(nodes):
            length = self.edge_len[nodes]
            at = self.edge_at[nodes]
            got = np.concatenate([[0], np.cumsum(has[self.edge[self._ranges(at, length)]])])
            ends = np.cumsum(length)
            overlap = overlap + got[ends] - got[ends - length]
            leaf = self.is_leaf[nodes]
            done = leaf >= 0
            done[done] = wanted[leaf[done]]
            y = leaf[done]
            found.append(y[(NUM + DEN) * overlap[done] >= NUM * (n + self.n[y])])
            # Remaining tokens: of the deepest set below, and of the probe after the path's last token.
            last = np.where(length > 0, self.edge[np.maximum(at + length - 1, 0)], -1) if len(self.edge) else np.full(len(nodes), -1)
            rest = np.minimum(self.longest[nodes] - self.depth[nodes], np.where(last >= 0, len(tokens) - left[last + 1], len(tokens)))
            a, b = self.span[nodes, 0], self.span[nodes, 1]
            go = ((NUM + DEN) * (overlap + rest) >= NUM * (n + self.smallest[nodes])) & (alive[b] > alive[a])
            nodes, overlap = nodes[go], overlap[go]
            times = self.child_n[nodes]
            nodes, overlap = self.child[self._ranges(self.child_at[nodes], times)], np.repeat(overlap, times)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def trie_links(rid: np.ndarray, n: np.ndarray, sequences: list[np.ndarray], side: np.ndarray, known: np.ndarray) -> tuple[list, list]:
    """Edges that connect whatever the links among these sets connect.

    side: 0 for sets that are only matched against, 1 for probes (matched against all).  known: a set already
    linked with the block's leader carries the leader's id, others their own.
    """
    if not len(rid):
        return [], []
    trie = Trie(sequences, n)
    rid, side, known = rid[trie.order], side[trie.order], known[trie.order]
    label = np.unique(known, return_inverse=True)[1]
    a, b = [], []
    for i in np.flatnonzero(side == 1):
        other = label != label[i]
        if not other.any():
            continue
        hits = trie.linked(trie.sets[i], int(trie.n[i]), other)
        for j in hits:
            if label[j] != label[i]:
                a.append(int(rid[i]))
                b.append(int(rid[j]))
                label[label == label[j]] = label[i]
    return a, b


def _match(table: pa.Table) -> pa.Table:
    frame = table.select(["_rid", "n", "tokens", "probe", "known"]).to_pandas().sort_values(["_rid", "probe"]).drop_duplicates("_rid", keep="last")
    sequences = [np.frombuffer(t, np.uint64) for t in frame["tokens"]]
    a, b = trie_links(frame["_rid"].to_numpy(), frame["n"].to_numpy(), sequences, frame["probe"].to_numpy(), frame["known"].to_numpy())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, tokens, ln, ltokens in zip(*(batch.column(c).to_pylist() for c in ("n", "tokens", "ln", "ltokens")), strict=True):
            both = len(np.intersect1d(np.frombuffer(tokens, np.uint64), np.frombuffer(ltokens, np.uint64), assume_unique=True))
            out.append((NUM + DEN) * both >= NUM * (n + ln))
        yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("_rid"), pa.array(out, pa.bool_())], ["leader", "_rid", "linked"])


def tree_blocks(sets: DataFrame, most: int = BLOCK_SETS) -> tuple[DataFrame, DataFrame]:
    """(tasks, edges): which sets each tree task gets, and the links of large blocks' sets with their leaders.

    Every pair of sets with a common prefix shingle meets in the block of that shingle's smallest set.  In a
    block of more than ``most`` sets those linked with the leader are one component already, so only the
    others (the probes) have to meet everything; both sides are dealt over a grid of tasks.
    """
    prefix = sets.select("_rid", F.explode("prefix").alias("token"))
    lead = prefix.groupBy("token").agg(F.min("_rid").alias("leader"), F.max("_rid").alias("_top")).where("_top > leader").drop("_top")
    member = cut(salted_join(prefix, lead, ["token"], ["_rid"], how="inner").select("leader", "_rid").distinct())
    sizes = cut(member.groupBy("leader").agg(F.count("*").alias("m")))
    body = sets.select("_rid", "n", "tokens")
    large = sizes.where(F.col("m") > most)
    if large.isEmpty():
        tasks = member.join(body, "_rid").select("leader", F.lit(0).alias("i"), F.lit(0).alias("j"), "_rid", "n", "tokens", F.lit(1).alias("probe"), F.col("_rid").alias("known"))
        return tasks, sets.select(F.col("_rid").alias("a"), F.col("_rid").alias("b")).limit(0)
    small = member.join(sizes.where(F.col("m") <= most).select("leader"), "leader", "left_semi")
    tasks = small.join(body, "_rid").select("leader", F.lit(0).alias("i"), F.lit(0).alias("j"), "_rid", "n", "tokens", F.lit(1).alias("probe"), F.col("_rid").alias("known"))
    heads = body.select(F.col("_rid").alias("leader"), F.col("n").alias("ln"), F.col("tokens").alias("ltokens")).join(large.select("leader"), "leader", "left_semi")
    big = salted_join(member.join(body, "_rid"), heads, ["leader"], ["_rid"], how="inner")
    checked = cut(big.mapInArrow(_with_leader, "leader long, _rid long, linked boolean"))
    edges = checked.where("linked AND leader <> _rid").select(F.col("leader").alias("a"), F.col("_rid").alias("b"))
    open_ = checked.where("NOT linked").groupBy("leader").agg(F.count("*").alias("u"))
    grid = large.join(open_, "leader").select("leader", F.ceil(F.col("m") / most).cast("int").alias("gm"), F.ceil(F.col("u") / most).cast("int").alias("gu"))
    placed = salted_join(checked.join(body, "_rid"), grid, ["leader"], ["_rid"], how="inner").withColumn("h", F.xxhash64("_rid"))
    cells = placed.select("*", F.pmod("h", F.col("gm").cast("long")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("gu") - 1)).alias("j")).withColumn("probe", F.lit(0))
    own = placed.where("NOT linked").select("*", F.explode(F.sequence(F.lit(0), F.col("gm") - 1)).alias("i"), F.pmod("h", F.col("gu").cast("long")).cast("int").alias("j")).withColumn("probe", F.lit(1))
    known = F.when(F.col("linked"), F.col("leader")).otherwise(F.col("_rid"))
    pick = ["leader", "i", "j", "_rid", "n", "tokens", "probe", known.alias("known")]
    return tasks.union(cells.select(pick)).union(own.select(pick)), edges


def ngram_components(docs: DataFrame, width: int = WIDTH, most: int = BLOCK_SETS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): _rid, doc_id, n_shingles, component_id, class_id, keep.

    class_id names rows with equal sets.  keep is true for one row of each component (the smallest doc_id, then
    the first row) and for every row with an empty set.  ``docs`` must be a stored table (see with_row_id).
    """
    rows = with_row_id(docs)
    profile = profiles(rows, width)
    filled = profile.where("n > 0")
    classes = cut(filled.groupBy("n", "d1", "d2").agg(F.min("_rid").alias("rep"), F.min("doc_id").alias("class_doc"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_rid")).alias("_best")))
    wanted = profile.where("levels IS NOT NULL").select("_rid", "levels").join(classes.select(F.col("rep").alias("_rid")), "_rid", "left_semi")
    sets = ordered_sets(rows, wanted, width)
    tasks, direct = tree_blocks(sets, most)
    found = tasks.groupBy("leader", "i", "j").applyInArrow(_match, "a long, b long")
    labels = component_labels(found.union(direct))
    named = cut(salted_join(classes, labels.select(F.col("v").alias("rep"), "label"), ["rep"], ["rep"]).withColumn("label", F.coalesce("label", "rep")))
    best = named.groupBy("label").agg(F.min("class_doc").alias("component_id"), F.min("_best").alias("_best"))
    full = salted_join(named.drop("_best"), best, ["label"], ["rep"]).select("n", "d1", "d2", F.col("rep").alias("class_id"), "component_id", F.col("_best._rid").alias("_kept"))
    out = salted_join(filled.drop("levels"), full, ["n", "d1", "d2"], ["_rid"], how="inner")
    out = out.select("_rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", (F.col("_rid") == F.col("_kept")).alias("keep"))
    empty = profile.where("n = 0").select("_rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("_rid").alias("class_id"), F.lit(True).alias("keep"))
    return out.union(empty)


def keep_one_per_component(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    docs = with_row_id(docs)
    kept = ngram_components(docs, width).where("keep").select("_rid")
    return docs.join(kept.hint("merge"), "_rid", "left_semi").drop("_rid")
