import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from recording import metadata, write_recording
from tickloom.operators.linear import LinearModel, load_models, save_models
from tickloom.session import cut, job_folder
from tickloom.sources import recordings as rec
from tickloom.sources.files import dealt, tasks_by_cores
from tickloom.sources.manifest import file_manifest, ready, reclaim, recording_flags, verified
from tickloom.sources.stores import load_features, load_fills, not_stored, read_store, select_existing, write_store
from tickloom.sources.versions import ConcurrentWrite, VersionLog


def test_scan_order_and_market(spark, tmp_path):
    rows = write_recording(tmp_path / "events_a.jsonl.gz", "M9", n=50, seed=3)
    scanned = rec.scan_recordings(spark, str(tmp_path))
    got = [r.event_type for r in scanned.orderBy("block", "line").collect()]
    assert got == [r["event_type"] for r in rows]
    market = rec.market_dimension(rec.file_dimension(scanned)).first()
    assert (market.ticker, market.close_ts - market.open_ts, market.strike, market.fragments) == ("M9", 900, 100.0, 1)


def test_tolerant_scan_keeps_what_is_readable(spark, tmp_path):
    lines = "".join(json.dumps({"event_type": "trade", "n": i}) + "\n" for i in range(2000))
    (tmp_path / "whole.jsonl.gz").write_bytes(gzip.compress((lines + "{broken\n").encode()))
    cut = gzip.compress(lines.encode())
    (tmp_path / "cut.jsonl.gz").write_bytes(cut[: len(cut) // 2])
    (tmp_path / "plain.jsonl").write_text('{"a": 1}\n\nnot json\n')
    for name in ("events_fizz", "z", "gz", "a.z", "agz"):
        (tmp_path / name).write_text('{"a": 1}\n')
    (tmp_path / "two.gz").write_bytes(gzip.compress(b'{"a": 1}\n{"a"') + gzip.compress(b': 2}\n'))
    by_file = {
        r.name: r for r in rec.scan_lines(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1)).groupBy("name")
        .agg(F.count_if("readable").alias("ok"), F.count_if(~F.col("readable")).alias("bad"), F.bool_and("complete").alias("complete")).collect()
    }
    assert (by_file["whole.jsonl.gz"].ok, by_file["whole.jsonl.gz"].bad, by_file["whole.jsonl.gz"].complete) == (2000, 1, True)
    assert 0 < by_file["cut.jsonl.gz"].ok < 2000 and by_file["cut.jsonl.gz"].bad == 0 and not by_file["cut.jsonl.gz"].complete
    assert (by_file["plain.jsonl"].ok, by_file["plain.jsonl"].bad) == (1, 1)
    assert all(by_file[name].ok == 1 for name in ("events_fizz", "z", "gz", "a.z", "agz"))
    assert (by_file["two.gz"].ok, by_file["two.gz"].bad, by_file["two.gz"].complete) == (2, 0, True)


def test_envelopes_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', 2.5)], "t long, s string, x double")
    rows = rec.envelope_rows(df, F.col("s"), F.lit("kind"), F.struct("x"), F.col("t"))
    rec.append_envelopes(rows, str(tmp_path / "out"), F.lit("M1"), F.lit("events_1"))
    back = rec.scan_recordings(spark, str(tmp_path / "out")).first()
    assert (back.source, back.event_type, back.receive_ts_ms, json.loads(back.payload)) == ('a"b', "kind", 1, {"x": 2.5})


def test_store_is_idempotent_and_tolerates_missing_columns(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_store(spark, path) is None
    rows = spark.createDataFrame([("A", 86_400_000, 0.5), ("B", 2 * 86_400_000, 0.7)], "ticker string, ts_ms long, mid double")
    write_store(rows, path)
    tickers = spark.createDataFrame([("A",), ("C",)], "ticker string")
    assert [r.ticker for r in not_stored(tickers, read_store(spark, path)).collect()] == ["C"]
    write_store(rows.filter("ticker = 'A'").withColumn("mid", F.lit(0.9)), path, overwrite=True)
    assert {r.ticker: r.mid for r in read_store(spark, path).collect()} == {"A": 0.9, "B": 0.7}
    # Two tickers of one day: replacing one keeps the other; a ticker that leaves a day leaves nothing there.
    same_day = spark.createDataFrame([("D", 86_400_001, 0.1), ("A", 86_400_002, 0.9), ("D", 3 * 86_400_000, 0.2)], "ticker string, ts_ms long, mid double")
    write_store(same_day.filter("ticker = 'D'"), path)
    write_store(same_day.filter("ticker = 'D' and ts_ms < 90000000").withColumn("mid", F.lit(0.3)), path, overwrite=True)
    assert {(r.ticker, r.ts_ms, r.mid) for r in read_store(spark, path).collect()} == {("A", 86_400_000, 0.9), ("B", 2 * 86_400_000, 0.7), ("D", 86_400_001, 0.3)}
    loaded = load_features(spark, path, tickers)
    assert loaded.count() == 1 and loaded.first().jump_ratio is None
    assert select_existing(rows, ["mid", "absent"]).columns[-2:] == ["mid", "absent"]


def test_manifest_readiness_and_retention(spark, tmp_path):
    body = gzip.compress(b'{"event_type": "market_status_at_close"}\n{"event_type": "market_result"}\n')
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "events_1.jsonl.gz").write_bytes(body)
    (tmp_path / "d" / "events_2.jsonl.gz").write_bytes(gzip.compress(b'{"event_type": "trade"}\n'))
    m = file_manifest(spark, str(tmp_path), "pre", "bk")
    first = {r.key: r for r in m.collect()}["pre/d/events_1.jsonl.gz"]
    assert (first.size, first.sha256) == (len(body), hashlib.sha256(body).hexdigest())
    flags = recording_flags(rec.scan_lines(spark, str(tmp_path / "d")))
    got = {r.path.rsplit("/", 1)[1]: (r.a, r.b) for r in flags.select("path", ready(F.lit(100.0)).alias("a"), ready(F.lit(8000.0)).alias("b")).collect()}
    assert got == {"events_1.jsonl.gz": (True, True), "events_2.jsonl.gz": (False, True)}
    markers = m.select("bucket", "key", F.when(F.col("key").contains("_1"), F.col("size")).otherwise(0).alias("size"), "mtime_us", "sha256", F.lit(1000.0).alias("uploaded_at"))
    done = verified(m, markers)
    assert [r.key for r in done.collect()] == ["pre/d/events_1.jsonl.gz"]
    assert reclaim(done, 2000.0, 500.0).count() == 1 and reclaim(done, 1100.0, 500.0).count() == 0


def test_models_round_trip_and_null_scores(spark, tmp_path):
    m = LinearModel("logistic", ("a", "b"), (0.0, 1.0), (1.0, 2.0), (0.5, -1.0), 0.1, (90.0, 300.0), 12, {"base_rate": "0.3"})
    save_models(spark, [m], str(tmp_path / "m"))
    assert load_models(spark, str(tmp_path / "m")) == [m]
    row = spark.createDataFrame([(1.0, None)], "a double, b double").select(m.predict().alias("p"), m.score(True).alias("s")).first()
    assert row.p is None and abs(row.s - 0.6) < 1e-12


def test_metadata_has_a_default_grid(spark):
    raw = {**metadata("Z"), "price_ranges": []}
    df = spark.createDataFrame([(json.dumps(raw),)], "payload string").select(*rec.market_columns(F.col("payload")))
    assert [tuple(r) for r in df.first().price_ranges] == [(0.0, 1.0, 0.01)]


def test_a_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"T{i:02d}", 1000 + i, float(i)) for i in range(40)], "ticker string, ts_ms long, mid double")
    assert write_store(rows.repartition(4), path) == 1
    broken = spark.createDataFrame([("T05", 1), ("T06", 0)], "ticker string, ts_ms long").withColumn("mid", F.when(F.col("ts_ms") == 0, F.raise_error(F.lit("no")).cast("double")).otherwise(0.5))
    with pytest.raises(Exception, match="no"):
        write_store(broken, path, overwrite=True)
    assert read_store(spark, path).count() == 40 and VersionLog(spark, path).versions() == [1]
    # A writer that comes second finds its version taken, and nothing of it is seen.
    log = VersionLog(spark, path)
    base, files = log.snapshot()
    write_store(rows.filter("ticker = 'T01'").withColumn("mid", F.lit(-1.0)), path, overwrite=True)
    with pytest.raises(ConcurrentWrite):
        log.commit(base, files, [], list(files))
    assert {r.mid for r in read_store(spark, path, ["T01"]).collect()} == {-1.0} and read_store(spark, path).count() == 40
    assert read_store(spark, path, version=1).filter("ticker = 'T01'").first().mid == 1.0
    for i in range(12):
        write_store(rows.filter(f"ticker = 'T{i:02d}'").withColumn("mid", F.lit(100.0)), path, overwrite=True)
    now = read_store(spark, path)
    assert now.count() == 40 and now.filter("mid = 100").count() == 12
    assert VersionLog(spark, path).expire(1) > 0 and read_store(spark, path).count() == 40


def test_a_ticker_filter_skips_files(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(4000).selectExpr("format_string('T%03d', id % 200) AS ticker", "id AS ts_ms", "id / 7.0 AS mid")
        write_store(rows.repartition(4), path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    whole, some = read_store(spark, path), read_store(spark, path, ["T007"])
    assert some.count() == 20 and len(some.inputFiles()) < len(whole.inputFiles())
    allowed = load_fills(spark, path, spark.createDataFrame([("T007",), ("T150",)], "ticker string"))
    assert allowed.count() == 40 and len(allowed.inputFiles()) < len(whole.inputFiles())
    assert len(read_store(spark, path, since_ms=10**9).inputFiles()) <= 1 and read_store(spark, path, since_ms=10**9).count() == 0


def test_a_job_removes_its_written_tables(spark):
    with job_folder(spark) as folder:
        kept = cut(spark.range(5))
        assert kept.count() == 5 and kept.inputFiles()[0].replace("file://", "").startswith(folder.replace("file://", ""))
    assert not os.path.exists(folder.replace("file://", ""))
    assert cut(spark.range(3)).count() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_share_tasks_and_lose_no_line(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"M{i}").mkdir()
        (tmp_path / f"M{i}" / "events_a.jsonl").write_text("".join('{"event_type": "trade", "n": %d}\n' % n for n in range(i % 40)))
    lines = rec.scan_lines(spark, str(tmp_path), blockBytes=256, partBytes=512)
    cores = spark.sparkContext.defaultParallelism
    assert lines.rdd.getNumPartitions() <= 8 * cores < 300
    assert {r.ticker: r.n for r in rec.numbered(lines).groupBy("ticker").agg((F.max("number") + 1).alias("n")).collect()} == {f"M{i}": i % 40 or None for i in range(300)}
    assert lines.filter("line < 0").count() == 300


def test_blocks_are_not_broadcast_to_their_lines(spark, tmp_path):
    write_recording(tmp_path / "events_a.jsonl", "M1", n=200, seed=5)
    lines = rec.numbered(rec.scan_lines(spark, str(tmp_path), blockBytes=1024))
    assert "BroadcastHashJoin" not in plan_of(lines)
    assert [r.number for r in lines.filter("line >= 0").orderBy("number").collect()] == list(range(lines.filter("line >= 0").count()))


def test_many_files_are_dealt_to_tasks_by_cores(spark):
    files = spark.range(2000).selectExpr("CONCAT('f', id) AS path")
    tasks = dealt(files, tasks_by_cores(spark))
    assert tasks.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism
    assert tasks.count() == tasks.distinct().count() == 2000
    assert dealt(files.limit(3), tasks_by_cores(spark)).rdd.getNumPartitions() == 3
