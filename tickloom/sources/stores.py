"""Feature and label stores as versioned tables (see ``versions``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.fit import BOOK_FEATURES, EXT_FEATURES, VALUE_TARGET
from tickloom.plans.variants import MIRRORED_FEATURES
from tickloom.session import cut
from tickloom.sources.versions import VersionLog, holding

# Columns the fits consume (state, target, outcome, features of any set or side); absent ones (older files) read as null.
FIT_COLUMNS = sorted({"seconds_to_close", "gbm_fair", "mid", "outcome_yes", VALUE_TARGET, *BOOK_FEATURES, *EXT_FEATURES, *(set(MIRRORED_FEATURES) - {n for n in MIRRORED_FEATURES if n.startswith("adv_")})})
MAX_NAMED = 10_000  # tickers that choose files one by one; more of them choose by their range


def read_store(spark: SparkSession, path: str, tickers: Sequence[str] | None = None, since_ms: int | None = None, until_ms: int | None = None, version: int | None = None) -> DataFrame | None:
    """The stored table (of a version), or None when nothing has been written yet.

    Files whose tickers or times lie outside what is wanted are not read.
    """
    log = VersionLog(spark, path)
    found = log.snapshot(version)
    if found is None:
        return None
    files = list(found[1].values())
    chosen = holding(files, tickers, since=since_ms, until=until_ms)
    rows = log.read(chosen or files[:1])
    if not chosen:
        rows = rows.limit(0)
    return rows if tickers is None else rows.filter(F.col("ticker").isin(list(tickers)))


def not_stored(candidates: DataFrame, stored: DataFrame | None, key: str = "ticker") -> DataFrame:
    """Candidates whose key is not in the store yet."""
    return candidates if stored is None else candidates.join(stored.select(key).distinct(), key, "left_anti")


def write_store(rows: DataFrame, path: str, t: str = "ts_ms", overwrite: bool = False) -> int:
    """Append rows as a new version; ``overwrite`` replaces the tickers present in ``rows``.  Returns the version.

    Rows are clustered by (ticker, time), so a ticker filter skips files and a heavy ticker still spreads over several
    writers.  A replacement rewrites the files that hold one of the tickers, with what else is in them.
    """
    log = VersionLog(rows.sparkSession, path)
    base, files = log.snapshot() or (0, {})
    removed: list[str] = []
    if overwrite and files:
        rows = cut(rows)
        tickers = cut(rows.select("ticker").distinct())
        low, high = tickers.agg(F.min("ticker"), F.max("ticker")).first()
        near = holding(list(files.values()), low=low, high=high) if low is not None else []
        if near:
            named = log.read(near).withColumn("_file", F.concat_ws("/", F.element_at(F.split(F.input_file_name(), "/"), -2), F.element_at(F.split(F.input_file_name(), "/"), -1)))
            hit = named.select("ticker", "_file").join(tickers, "ticker", "left_semi").select("_file").distinct()
            removed = [r["_file"] for r in hit.collect()]  # files of the log
        if removed:
            stay = log.read([files[p] for p in removed]).join(tickers, "ticker", "left_anti")
            rows = stay.unionByName(rows, allowMissingColumns=True)
    return log.commit(base, files, log.write_files(rows, "ticker", t), removed)


def select_existing(df: DataFrame, columns: Sequence[str], cast: str | None = "double") -> DataFrame:
    """Named columns, typed null where the store does not have them."""
    present = set(df.columns)
    out = [
        (F.col(c).cast(cast) if cast else F.col(c)) if c in present else F.lit(None).cast(cast or "double")
        for c in columns
    ]
    keys = [c for c in ("ticker", "ts_ms") if c in present and c not in columns]
    return df.select(*keys, *[e.alias(c) for e, c in zip(out, columns)])


def _allowed(spark: SparkSession, path: str, tickers: DataFrame | None) -> DataFrame:
    """Rows of the allowed tickers, from files that may hold them."""
    if tickers is None:
        return read_store(spark, path)
    log = VersionLog(spark, path)
    _, files = log.snapshot()
    names = [r[0] for r in tickers.select("ticker").distinct().limit(MAX_NAMED + 1).collect()]
    if len(names) <= MAX_NAMED:
        chosen = holding(list(files.values()), names)
    else:
        low, high = tickers.agg(F.min("ticker"), F.max("ticker")).first()
        chosen = holding(list(files.values()), low=low, high=high)
    rows = log.read(chosen) if chosen else log.read(list(files.values())[:1]).limit(0)
    return rows.join(tickers.select("ticker"), "ticker", "left_semi")


def load_features(spark: SparkSession, path: str, tickers: DataFrame | None = None) -> DataFrame:
    """Fit columns of the allowed windows only (``tickers``: one column)."""
    return select_existing(_allowed(spark, path, tickers), FIT_COLUMNS)


def load_fills(spark: SparkSession, path: str, tickers: DataFrame | None = None) -> DataFrame:
    return _allowed(spark, path, tickers)


def compact(spark: SparkSession, windows, path: str, final: DataFrame, build, t: str = "ts_ms", overwrite: bool = False) -> DataFrame:
    """Build and store the final windows that are not in the store yet; returns the tickers written.

    ``build(windows)`` makes the rows.  A second run finds nothing to do.
    """
    todo = final.select("ticker") if overwrite else not_stored(final.select("ticker"), read_store(spark, path))
    narrowed = type(windows).of(
        windows.events.join(todo, "ticker", "left_semi"), windows.markets.join(todo, "ticker", "left_semi"), windows.slice_ms
    )
    if not todo.isEmpty():
        write_store(build(narrowed), path, t, overwrite)
    return todo
