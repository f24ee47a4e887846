"""Registry of runnable queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one exists, the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with ``t`` in epoch microseconds and the JSON counter ``k``."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
        .withColumn("k", F.from_json("props", "k int")["k"])
        .drop("ts", "props")
    )


# The same view for the SQL side.
EVENTS_SQL = "e AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines; negative zero becomes zero."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            out.append((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
