"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, doc_id), so equal texts stand together.  A size-weighted sample of
these keys (at most about ``SAMPLE`` a range reach the driver) gives quantile boundaries; each record finds its
range by binary search in them.  Ranges that turn out overfull get boundaries of their own sample, until each
range is one bounded task.  A range's running sum of sizes on top of the ranges before it is a record's exact
place on the byte line, and its shard is the sixteenth (``shards``-th) of the line that its middle lies in.

So shards are equal in bytes up to one record.  A group of equal texts stays in one shard if it is no larger
than the largest record or a hundredth of a shard; larger groups are split where the line says.  The law is
``bytes``.  Null texts have no bytes: size 1, checksum of nothing, a group of their own with the empty texts.
Null doc_ids come first in their group.  Repeated rows are records like others.  Extra columns stay; an empty
table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.session import cut

SAMPLE = 64  # expected samples for each range
RANGE_ROWS = 250_000
MAX_RANGES = 8192
LOWEST = -(1 << 63)


def _constants(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below (_h, _d), by binary search."""
    if not splitters:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    table = _constants([{"h": h, "d": d} for h, d in splitters], "struct<h:bigint,d:bigint>")
    key = F.struct(F.col("_h").alias("h"), F.col("_d").alias("d"))
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))


def _quantiles(rows: list, total: float, ranges: int) -> list[tuple[int, int]]:
    """Keys that cut the samples' weight into equal parts; at a group's start unless several cut the group."""
    if not rows:
        return []
    rows = sorted((r["_h"], r["_d"], r["w"]) for r in rows)
    line = np.cumsum([r[2] for r in rows])
    at = np.searchsorted(line, np.arange(1, ranges) * (line[-1] / ranges))
    picked = sorted({(rows[min(i, len(rows) - 1)][0], rows[min(i, len(rows) - 1)][1]) for i in at})
    hot: dict[int, int] = {}
    for h, _ in picked:
        hot[h] = hot.get(h, 0) + 1
    return sorted({(h, d if hot[h] > 1 else LOWEST) for h, d in picked} | {(h, LOWEST) for h, n in hot.items() if n > 1})


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with _h, _d (the order), _size and _crc."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))
    return docs.withColumns({"_h": F.xxhash64(body), "_d": d, "_size": (F.octet_length(body) + 1).cast("long"), "_crc": F.crc32(body.cast("binary"))})


def splitters_of(narrow: DataFrame, rows: int, total: int, seed: int, range_rows: int) -> list[tuple[int, int]]:
    ranges = int(min(MAX_RANGES, max(64, rows / range_rows)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "_h", "_d"), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def sampled(df: DataFrame, amount: Column, whole: Column, wanted: Column) -> list:
        p = F.least(F.lit(1.0), wanted * amount / whole)
        return df.withColumn("_p", p).where(draw < F.col("_p")).select("_h", "_d", (amount / F.col("_p")).alias("w"), *([c for c in df.columns if c == "_r"])).collect()

    found = _quantiles(sampled(narrow, F.col("_size"), F.lit(float(total)), F.lit(float(SAMPLE * ranges))), total, ranges)
    for _ in range(8):  # subdivide what is overfull; rows with one key can't be told apart and end this early
        full = narrow.withColumn("_r", _range_of(found)).groupBy("_r").agg(F.count("*").alias("n"), F.sum("_size").alias("b"), F.min(F.struct("_h", "_d")).alias("lo"), F.max(F.struct("_h", "_d")).alias("hi"))
        over = full.where((F.col("n") > 4 * range_rows) | ((F.col("b") > 4 * total / ranges) & (F.col("n") > range_rows))).where("lo < hi").limit(MAX_RANGES).collect()
        if not over or len(found) >= 2 * MAX_RANGES:
            break
        which = {r["_r"]: r["n"] for r in over}
        inside = narrow.withColumn("_r", _range_of(found)).where(F.col("_r").isin(list(which)))
        size = F.element_at(F.create_map(*(F.lit(x) for pair in which.items() for x in pair)), F.col("_r")).cast("double")
        picks = sampled(inside, F.lit(1.0), size, F.ceil(size / range_rows) * SAMPLE)
        before = len(found)
        for r, n in which.items():
            found += _quantiles([x for x in picks if x["_r"] == r], n, -(-n // range_rows) + 1)
        found = sorted(set(found))
        if len(found) == before:
            break
    return found


def shard_records(docs: DataFrame, shards: int = 16, seed: int = 29, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` with _h, _d, _size, _crc, shard and slot (gapless from 0 in each shard)."""
    wide = keyed(docs)
    narrow = cut(wide.select("_h", "_d", "_size"))
    rows, total, largest = narrow.agg(F.count("*"), F.sum("_size"), F.max("_size")).first()
    if not rows:
        return wide.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    splitters = splitters_of(narrow, rows, total, seed, range_rows)
    sums = {r["_r"]: (r["b"], r["n"]) for r in narrow.groupBy(_range_of(splitters).alias("_r")).agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect()}
    ahead, seen, lines = [0, 0], [], []
    for r in range(len(splitters) + 1):
        lines.append(ahead[0])
        seen.append(ahead[1])
        ahead = [ahead[0] + sums.get(r, (0, 0))[0], ahead[1] + sums.get(r, (0, 0))[1]]
    whole = max(largest, total // shards // 100)

    def placed(df: DataFrame) -> DataFrame:
        line = Window.partitionBy("_r").orderBy("_h", "_d", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        group = Window.partitionBy("_r", "_h")
        ranged = df.withColumn("_r", _range_of(splitters))
        run = ranged.withColumns({"_upto": F.get(_constants(lines, "bigint"), F.col("_r")) + F.sum("_size").over(line), "_row": F.get(_constants(seen, "bigint"), F.col("_r")) + F.count(F.lit(1)).over(line) - 1})
        grouped = run.withColumns({"_g": F.sum("_size").over(group), "_from": F.min(F.col("_upto") - F.col("_size")).over(group)})
        middle = F.when(F.col("_g") <= whole, F.col("_from") + F.col("_g") / 2).otherwise(F.col("_upto") - F.col("_size") / 2)
        return grouped.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / total * shards)).cast("int")).drop("_upto", "_g", "_from", "_r")

    first = {r["shard"]: r["f"] for r in placed(narrow).groupBy("shard").agg(F.min("_row").alias("f")).collect()}
    starts = _constants([first.get(s, 0) for s in range(shards)], "bigint")
    return placed(wide).withColumn("slot", F.col("_row") - F.get(starts, F.col("shard"))).drop("_row")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write ``docs`` as Parquet, one folder a shard, in slot order within each file."""
    out = shard_records(docs, shards).drop("_h", "_d", "_size", "_crc")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
