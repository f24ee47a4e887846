"""Queries that write the derived recording as files, fragments of every window, and read them again.

Each window becomes a plain fragment (``events_a``) and a packed one (``events_b``); the first holds one broken
line, and every fifth window's second one ends within a further gzip member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.base import query, rounded
from tickloom.catalog.market import START_SQL, TICKER_SQL
from tickloom.catalog.recording import BASE_MS, DERIVED_SQL, EXCHANGE, WINDOW_MS, derived_events, derived_windows
from tickloom.catalog.streams import fresh_folder
from tickloom.operators.audit import audit
from tickloom.operators.slices import running
from tickloom.schemas import INDEX_EVENT
from tickloom.session import cut
from tickloom.sources import recording_source
from tickloom.sources import recordings as rec
from tickloom.sources.files import dealt, tasks_by_cores
from tickloom.sources.manifest import file_manifest, recording_flags
from tickloom.sources.stores import compact, load_fills
from tickloom.sources.versions import VersionLog

NOW_MS = BASE_MS + 10**9
BLOCK = 4096  # bytes, so that small files have many blocks too
TORN_EVERY = 5

# Every line of every file: w, frag, t and line order, and what it holds.
FILES_SQL = f"""{DERIVED_SQL}, w0 AS (SELECT DISTINCT w FROM r),
    x AS (SELECT w, t, event_id + 10 AS line, 'exchange' AS source, CASE WHEN snap THEN 'orderbook_snapshot' ELSE 'orderbook_delta' END AS kind, number AS seq FROM msgs
      UNION ALL SELECT w, t, event_id + 10, CASE WHEN event_type = 'signup' THEN CASE k % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'coinbase' ELSE 'kraken' END ELSE 'exchange' END,
        CASE WHEN event_type = 'error' THEN '{INDEX_EVENT}' WHEN event_type = 'purchase' THEN 'trade' WHEN k % 2 = 0 THEN 'spot' ELSE 'external_orderbook' END, NULL FROM r WHERE event_type NOT IN ('click', 'view')
      UNION ALL SELECT w, {START_SQL}, 1, 'exchange', 'feed_status', NULL FROM w0
      UNION ALL SELECT w, {START_SQL}, 2, 'exchange', 'orderbook_snapshot', 1 FROM w0
      UNION ALL SELECT w, {START_SQL} + 1, 3, 'system', NULL, NULL FROM w0
      UNION ALL SELECT w, {START_SQL} + {WINDOW_MS}, {1 << 40}, 'system', 'market_status_at_close', NULL FROM w0),
    l AS (SELECT w, CASE WHEN t < {START_SQL} + {WINDOW_MS // 2} THEN 'a' ELSE 'b' END AS frag, t, line, source, kind, seq FROM x
      UNION ALL SELECT w, f.frag, {START_SQL}, 0, 'system', 'market_metadata', NULL FROM w0, (VALUES ('a'), ('b')) AS f(frag))"""


def _torn(files: DataFrame) -> DataFrame:
    """Begin a further gzip member at the end of each file and leave it there."""

    def tear(batches):
        for batch in batches:
            for path in batch["path"]:
                store, name = recording_source.store_of(path)
                with store.open_append_stream(name, compression=None) as out:
                    out.write(b"\x1f\x8b\x08\x00")
            yield batch

    return dealt(files.select("path"), tasks_by_cores(files.sparkSession)).mapInPandas(tear, "path string")


def written_recording(spark: SparkSession, sf_dir: str) -> str:
    """Write the derived recording as files; returns their folder."""
    folder = f"{fresh_folder(spark)}/recordings"
    events = derived_events(spark, sf_dir).withColumn("ticker", F.substring_index("path", "/", -1))
    start = F.lit(BASE_MS) + F.regexp_extract("ticker", r"(\d+)", 1).cast("long") * WINDOW_MS
    first = events.filter("event_type = 'market_metadata'")
    broken = first.withColumns({"receive_ts_ms": start + 1, "line": F.lit(3).cast("long"), "event_type": F.lit("note"), "payload": F.lit('{"half":')})
    placed = events.unionByName(broken).withColumn("fragment", F.when(F.col("receive_ts_ms") < start + WINDOW_MS // 2, "events_a").otherwise("events_b"))
    placed = placed.unionByName(first.withColumn("fragment", F.lit("events_b")))
    suffix = F.when(F.col("fragment") == "events_a", ".jsonl").otherwise(".jsonl.gz")
    rec.append_envelopes(placed, folder, F.col("ticker"), F.col("fragment"), ["receive_ts_ms", "line"], suffix)
    files = spark.createDataFrame([(f.path, f.ticker) for f in recording_source.list_files([folder], "events_b*")], "path string, ticker string")
    cut(_torn(files.filter(F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % TORN_EVERY == 0)))
    return folder


def _fragment() -> Column:
    return F.regexp_extract("path", r"events_(\w)", 1).alias("fragment")


@query(
    "recording_files",
    f"""WITH {FILES_SQL} SELECT {TICKER_SQL} AS ticker, frag AS fragment, count(kind) AS rows, count(*) - count(kind) AS invalid_rows, frag = 'a' OR w % {TORN_EVERY} <> 0 AS complete,
      min(t) FILTER (kind IS NOT NULL) AS first_ts_ms, max(t) FILTER (kind IS NOT NULL) AS last_ts_ms, count(*) AS numbered FROM l GROUP BY w, frag""",
)
def recording_files(spark, sf_dir):
    """Write, tear, scan tolerantly, number the lines: one row a file."""
    lines = rec.numbered(rec.scan_lines(spark, written_recording(spark, sf_dir), rec.FAMILIES, blockBytes=BLOCK, partBytes=4 * BLOCK))
    ts = F.when(F.col("readable"), F.get_json_object("value", "$.receive_ts_ms").cast("long"))
    return lines.groupBy("path", "ticker").agg(
        F.count_if("readable").alias("rows"), F.count_if(~F.col("readable")).alias("invalid_rows"), F.bool_and("complete").alias("complete"), F.min(ts).alias("first_ts_ms"),
        F.max(ts).alias("last_ts_ms"), (F.max("number") + 1).alias("numbered"),
    ).select("ticker", _fragment(), "rows", "invalid_rows", "complete", "first_ts_ms", "last_ts_ms", "numbered")


@query(
    "recording_line_gaps",
    f"""WITH {FILES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY w, frag ORDER BY t, line) - 1 AS number FROM l),
    g AS (SELECT *, lag(seq) OVER (PARTITION BY w, frag ORDER BY number) AS before FROM n WHERE seq IS NOT NULL)
    SELECT {TICKER_SQL} AS ticker, frag AS fragment, number, seq, before FROM g WHERE seq > before + 1""",
)
def recording_line_gaps(spark, sf_dir):
    """Skipped sequence numbers with the exact line they show at, found across blocks."""
    lines = rec.numbered(rec.scan_lines(spark, written_recording(spark, sf_dir), blockBytes=BLOCK, partBytes=4 * BLOCK))
    seq = F.get_json_object("value", "$.payload.seq").cast("long")
    books = lines.select("path", "ticker", "number", seq.alias("seq")).filter("seq IS NOT NULL")
    stepped = running(cut(books), ["path", "ticker"], "number", None, 100, {"before": ("lag", F.col("seq"))})
    return stepped.filter("seq > before + 1").select("ticker", _fragment(), "number", "seq", "before")


@query(
    "recording_stitched",
    f"""WITH {FILES_SQL} SELECT {TICKER_SQL} AS ticker, kind AS event_type, count(*) AS n, sum(t - {START_SQL}) AS ms, 2::BIGINT AS fragments FROM l WHERE kind IS NOT NULL GROUP BY w, kind""",
)
def recording_stitched(spark, sf_dir):
    """All fragments of a window under its ticker; each file's own metadata row counts."""
    events = cut(rec.scan_recordings(spark, written_recording(spark, sf_dir)))
    files = rec.file_dimension(events)
    fragments = rec.market_dimension(files).select("ticker", "fragments", (F.col("open_ts") * 1000).alias("start"))
    stitched = rec.stitch(events, files).join(fragments, "ticker")
    return stitched.groupBy("ticker", "event_type", "fragments").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("receive_ts_ms") - F.col("start")).alias("ms")).select("ticker", "event_type", "n", "ms", "fragments")


@query(
    "newest_recording",
    f"""WITH {DERIVED_SQL}, m AS (SELECT w, max(t) AS last FROM r GROUP BY w)
    SELECT arg_max({TICKER_SQL}, (last, w)) AS ticker, max(last) AS last_ts_ms FROM m""",
)
def newest_recording(spark, sf_dir):
    """The file that changed last; a file's time is that of its last event but one, the close marker."""
    events = cut(derived_events(spark, sf_dir).filter("event_type <> 'market_status_at_close'").withColumn("modified", F.timestamp_millis("receive_ts_ms")))
    return rec.newest_file(events).select(F.substring_index("path", "/", -1).alias("ticker"), F.unix_millis("modified").alias("last_ts_ms"))


_MAP_SQL = "list_aggregate(list_sort(list(kind || '=' || n)), 'string_agg', ',')"
_SETS = ("channels", "venues", "depth_venues", "context")


@query(
    "recording_audit_full",
    f"""WITH {FILES_SQL}, c AS (SELECT w, frag, kind, count(*) AS n FROM l WHERE kind IS NOT NULL GROUP BY ALL), counts AS (SELECT w, frag, {_MAP_SQL} AS event_counts FROM c GROUP BY w, frag),
    g AS (SELECT w, frag, count(*) AS n FROM (SELECT w, frag, seq, lag(seq) OVER (PARTITION BY w, frag ORDER BY t, line) AS before FROM l WHERE seq IS NOT NULL) WHERE seq > before + 1 GROUP BY ALL),
    f AS (SELECT w, frag, count(kind) AS rows, min(t) FILTER (kind IS NOT NULL) AS first_ts_ms, max(t) FILTER (kind IS NOT NULL) AS last_ts_ms, count(*) - count(kind) AS invalid_rows,
      list_sort(list_distinct(list(source) FILTER (kind = 'spot'))) AS v, list_sort(list_distinct(list(source) FILTER (kind = 'external_orderbook'))) AS d,
      count(*) FILTER (kind = 'orderbook_snapshot') > 0 AND count(*) FILTER (kind = 'orderbook_delta') > 0 AS book, count(*) FILTER (kind = '{INDEX_EVENT}') > 0 AS idx FROM l GROUP BY w, frag),
    j AS (SELECT f.*, event_counts, g.n AS gaps, coalesce(v, []) AS vs, coalesce(d, []) AS ds, list_filter(['binance', 'coinbase', 'kraken'], lambda s: NOT list_contains(coalesce(v, []), s)) AS missing,
      frag = 'a' OR w % {TORN_EVERY} <> 0 AS whole FROM f JOIN counts USING (w, frag) LEFT JOIN g USING (w, frag))
    SELECT {TICKER_SQL} AS ticker, frag AS fragment, CASE frag WHEN 'a' THEN 'partial' ELSE 'complete' END AS status, rows, first_ts_ms, last_ts_ms, round((first_ts_ms - {START_SQL}) / 1000.0::DOUBLE, 6) + 0.0 AS start_offset_s,
      round((last_ts_ms - {START_SQL} - {WINDOW_MS}) / 1000.0::DOUBLE, 6) + 0.0 AS end_offset_s, '' AS channels, array_to_string(vs, ',') AS venues, array_to_string(ds, ',') AS depth_venues, 'market_metadata' AS context, event_counts,
      0::BIGINT AS sequence_gaps, CASE WHEN gaps IS NOT NULL THEN 'orderbook=' || gaps END AS channel_seq_gaps, NULL::VARCHAR AS external_feed_issues, invalid_rows, whole AS gzip_complete,
      array_to_string(list_filter(['no_subscription=cfbenchmarks_value|market_lifecycle_v2|orderbook_delta|ticker|trade', CASE WHEN len(missing) > 0 THEN 'no_reference_price=' || array_to_string(missing, '|') END,
        'no_context=market_incentives|series_fee_changes|series_metadata', CASE WHEN NOT book THEN 'no_book' END, CASE WHEN NOT idx THEN 'no_index' END, CASE WHEN invalid_rows > 0 THEN 'unreadable_rows=' || invalid_rows END,
        CASE WHEN NOT whole THEN 'gzip_cut' END], lambda s: s IS NOT NULL), ',') AS errors,
      array_to_string(list_filter([CASE WHEN gaps IS NOT NULL THEN 'channel_gaps=orderbook|' || gaps END, CASE WHEN frag = 'a' THEN 'no_close_marker' END], lambda s: s IS NOT NULL), ',') AS warnings, false AS healthy FROM j""",
)
def recording_audit_full(spark, sf_dir):
    """All columns of the audit, from files; a file's channel is scanned in slices of a few blocks."""
    lines = cut(rec.scan_lines(spark, written_recording(spark, sf_dir), rec.FAMILIES, blockBytes=BLOCK, partBytes=4 * BLOCK))
    a = audit(lines, NOW_MS, EXCHANGE, width=2 * BLOCK)

    def joined(counts: str) -> Column:
        return F.array_join(F.array_sort(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias(counts)

    return rounded(
        a.select(
            F.element_at(F.split("path", "/"), -2).alias("ticker"), _fragment(), "status", "rows", "first_ts_ms", "last_ts_ms", "start_offset_s", "end_offset_s",
            *(F.array_join(F.array_sort(c), ",").alias(c) for c in _SETS), joined("event_counts"), "sequence_gaps", joined("channel_seq_gaps"), joined("external_feed_issues"), "invalid_rows", "gzip_complete",
            F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "healthy",
        )
    )


@query(
    "recording_flags",
    f"""WITH {FILES_SQL} SELECT {TICKER_SQL} AS ticker, frag AS fragment, frag = 'b' AS closed, false AS finalized, frag = 'b' AND w % {TORN_EVERY} <> 0 AS readable FROM (SELECT DISTINCT w, frag FROM l)""",
)
def recording_flag_rows(spark, sf_dir):
    """Which files are closed, finalised and readable to their end."""
    flags = recording_flags(rec.scan_lines(spark, written_recording(spark, sf_dir)))
    return flags.select(F.element_at(F.split("path", "/"), -2).alias("ticker"), _fragment(), "closed", "finalized", "readable")


@query(
    "file_manifest_digests",
    f"""WITH {FILES_SQL} SELECT {TICKER_SQL} AS ticker, frag AS fragment, 'archive/' || {TICKER_SQL} AS folder, true AS digest_fits, true AS size_fits FROM (SELECT DISTINCT w, frag FROM l)""",
)
def file_manifest_digests(spark, sf_dir):
    """Sizes and digests of all files, read in blocks, against Spark's own digest of the whole content."""
    folder = written_recording(spark, sf_dir)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("want"), F.col("length").alias("n"))
    found = file_manifest(spark, folder, "archive", "bucket").join(whole, "path")
    key = F.regexp_replace("key", "/[^/]*$", "")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("ticker"), _fragment(), key.alias("folder"), (F.col("sha256") == F.col("want")).alias("digest_fits"), (F.col("size") == F.col("n")).alias("size_fits"))


@query(
    "stream_recordings",
    f"""WITH {FILES_SQL} SELECT {TICKER_SQL} AS ticker, kind AS event_type, count(*) AS n, count(*) FILTER (frag = 'a') AS in_first, to_timestamp(any_value({BASE_MS // 1000} + w * {WINDOW_MS // 1000}))::DATE AS day
    FROM l WHERE kind IS NOT NULL GROUP BY w, kind""",
)
def stream_recordings(spark, sf_dir):
    """Files that land in two steps, taken up by two runs of one stream and appended to the event table by day."""
    from tickloom.streaming import live

    whole = written_recording(spark, sf_dir)
    landing, out, checkpoint = (fresh_folder(spark) for _ in range(3))
    scanned = cut(rec.scan_recordings(spark, whole).withColumns({"ticker": F.element_at(F.split("path", "/"), -2), "fragment": _fragment()}))
    for fragment in ("a", "b"):
        rec.append_envelopes(scanned.filter(F.col("fragment") == fragment), landing, F.col("ticker"), F.concat(F.lit("events_"), "fragment"), ["block", "line"])
        live.ingest(live.recording_stream(spark, landing), out, checkpoint, once=True).awaitTermination()
    events = spark.read.parquet(out)
    starts = F.to_date(F.timestamp_millis(F.lit(BASE_MS) + F.regexp_extract("ticker", r"(\d+)", 1).cast("long") * WINDOW_MS))
    return events.groupBy("ticker", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("path").contains("events_a")).alias("in_first")).withColumn("day", starts)


@query(
    "store_compaction",
    f"""WITH {DERIVED_SQL} SELECT {TICKER_SQL} AS ticker, count(*) AS n, CASE WHEN w % 2 = 1 OR w % 3 = 0 THEN CAST(sum(count) AS DOUBLE) END AS contracts, round(sum(CASE WHEN w % 3 = 0 THEN -price ELSE price END), 4) AS prices,
      3 AS version FROM trade GROUP BY w""",
)
def store_compaction(spark, sf_dir):
    """Trades of final windows, stored in three versions: half of the windows without counts, the rest with, a third replaced."""
    windows, path = derived_windows(spark, sf_dir), f"{fresh_folder(spark)}/store"
    final = rec.final_windows(windows.markets, NOW_MS / 1000).select("ticker")
    number = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")

    def trades(w) -> DataFrame:
        return w.trades.select("ticker", F.col("receive_ts_ms").alias("ts_ms"), "price", "count")

    compact(spark, windows, path, final.filter(number % 2 == 0), lambda w: trades(w).drop("count"))
    compact(spark, windows, path, final, trades)
    compact(spark, windows, path, final.filter(number % 3 == 0), lambda w: trades(w).withColumn("price", -F.col("price")), overwrite=True)
    stored = load_fills(spark, path, final)
    version = VersionLog(spark, path).snapshot()[0]
    return rounded(stored.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("contracts"), F.sum("price").alias("prices"), F.lit(version).alias("version")), 4)


@query(
    "final_windows_readable",
    f"""WITH {DERIVED_SQL} SELECT DISTINCT {TICKER_SQL} AS ticker FROM r WHERE {BASE_MS // 1000 + 9000} > {START_SQL} // 1000 + 900 + 3600 OR w % {TORN_EVERY} <> 0""",
)
def final_windows_readable(spark, sf_dir):
    """Windows that closed lately count as final only if their second fragment can be read to its end."""
    flags = recording_flags(rec.scan_lines(spark, written_recording(spark, sf_dir), "events_b*"))
    unreadable = flags.filter(~F.col("readable")).select(F.element_at(F.split("path", "/"), -2).alias("ticker"))
    markets = rec.market_dimension(rec.file_dimension(cut(derived_events(spark, sf_dir))))
    return rec.final_windows(markets, BASE_MS / 1000 + 9000, unreadable).select("ticker")
