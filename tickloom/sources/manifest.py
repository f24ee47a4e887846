"""File manifest with digests, archive readiness and retention selection (no upload, no deletion)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.slices import running
from tickloom.sources.files import dealt, read_blocks, tasks_by_cores
from tickloom.sources.recordings import FILE_PATTERN

# Ages in seconds that decide when a recording may be archived.
STABLE_AGE_S = 60.0
SETTLEMENT_GRACE_S = 900.0
ORPHAN_AGE_S = 7_200.0
BACKLOG_ALARM_S = 1_800.0


def file_manifest(spark: SparkSession, root: str, prefix: str, bucket: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """One row per recording: path, size, digest, mtime and archive key."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    )
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    relative = F.substr(F.regexp_replace("path", "^file:/*", "/"), F.length(base) + F.lit(2))
    key = F.concat_ws("/", F.when(F.lit(prefix.strip("/")) != "", F.lit(prefix.strip("/"))), relative)
    listed = files.select("path", F.lit(bucket).alias("bucket"), key.alias("key"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"))

    def digest(batches):
        for batch in batches:
            sums = []
            for path in batch["path"]:
                total = hashlib.sha256()
                for block in read_blocks(path):
                    total.update(block)
                sums.append(total.hexdigest())
            yield batch.assign(sha256=sums)

    # Files are read in blocks by the tasks; no file is held whole.
    schema = "path string, bucket string, key string, size bigint, mtime_us bigint, sha256 string"
    return dealt(listed, tasks_by_cores(spark)).mapInPandas(digest, schema).select("path", "bucket", "key", "size", "sha256", "mtime_us")


def verified(manifest: DataFrame, markers: DataFrame) -> DataFrame:
    """Manifest rows whose upload marker still matches bucket, key, size and mtime."""
    m = markers.select("bucket", "key", "size", "mtime_us", "sha256", "uploaded_at")
    return manifest.drop("sha256").join(m, ["bucket", "key", "size", "mtime_us"])


def recording_flags(lines: DataFrame) -> DataFrame:
    """(path, closed, finalized, readable) from a tolerant scan."""
    kind = F.get_json_object("value", "$.event_type")
    return lines.groupBy("path").agg(
        F.coalesce(F.bool_or(kind == "market_status_at_close"), F.lit(False)).alias("closed"),
        F.coalesce(F.bool_or(kind.isin("market_result", "market_result_error")), F.lit(False)).alias("finalized"),
        (F.coalesce(F.bool_and("readable"), F.lit(True)) & F.bool_and("complete")).alias("readable"),
    )


def ready(age_s: Column) -> Column:
    """May a recording with the given flags and age be archived?"""
    name = F.element_at(F.split("path", "/"), -1)
    unfinished = name.startswith("events_") & ~F.col("closed")
    return (
        (age_s >= STABLE_AGE_S)
        & F.col("readable")
        & F.when(unfinished, age_s >= ORPHAN_AGE_S).otherwise(F.col("finalized") | (age_s >= SETTLEMENT_GRACE_S))
    )


def archive_backlog(manifest: DataFrame, flags: DataFrame, markers: DataFrame, now_s: float) -> DataFrame:
    """Ready and pending counts, oldest pending age and whether it is alarming, newest marker."""
    age = F.lit(now_s) - F.col("mtime_us") / 1e6
    done = verified(manifest, markers).select("path", "uploaded_at")
    rows = manifest.join(flags, "path", "left").join(done, "path", "left").withColumn("_age", age).withColumn(
        "_pending", F.col("uploaded_at").isNull() & F.coalesce(ready(F.col("_age")), F.lit(False))
    )
    oldest = F.max(F.when(F.col("_pending"), F.col("_age")))
    return rows.agg(
        F.count_if(F.col("_pending") | F.col("uploaded_at").isNotNull()).alias("ready"),
        F.count_if("_pending").alias("pending"),
        oldest.alias("oldest_pending_s"),
        F.coalesce(oldest > max(SETTLEMENT_GRACE_S, BACKLOG_ALARM_S), F.lit(False)).alias("alarm"),
        F.max_by("key", F.when(F.col("uploaded_at").isNotNull(), F.col("uploaded_at"))).alias("newest_key"),
    )


def oldest_first(rows: DataFrame, t: str, seq: str, size: str, target: float, width: float) -> DataFrame:
    """Oldest rows until their sizes add up to ``target`` (the row that reaches it included)."""
    summed = running(rows, [], t, seq, width, {"freed": ("sum", F.col(size))})
    return summed.filter(F.col("freed") - F.col(size) < target)


def reclaim(done: DataFrame, now_s: float, retention_s: float, target_bytes: int = 0, width: float = 86_400.0) -> DataFrame:
    """Verified files to remove: past retention, then oldest first until ``target_bytes`` more are freed."""
    aged = F.col("uploaded_at") <= F.lit(now_s - retention_s)
    old = done.filter(aged).withColumn("reason", F.lit("retention"))
    if target_bytes <= 0:
        return old
    young = done.filter(~aged).withColumn("_t", F.col("mtime_us") / 1e6)
    return old.unionByName(
        oldest_first(young, "_t", "key", "size", target_bytes, width).drop("_t", "freed").withColumn("reason", F.lit("disk_pressure"))
    )
