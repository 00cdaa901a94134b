"""The package's data model over the test tables, in Spark and as SQL common table expressions.

Points are events (session: user_id modulo 8, time in microseconds); periods are views that last `value`
minutes and clicks that last half an hour; samples are the values of a session's events in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
HALF_HOUR = 30 * MINUTE


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    seconds = F.expr(f"CAST(CAST((CAST({ts} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ '1970-01-01 00:00:00') AS INTERVAL SECOND) AS DECIMAL(20, 6))")
    return (seconds * 1_000_000).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).cast("int").alias("session"), "user_id", "event_type", micros("ts").alias("us"), "value")


def points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == kind).select("session", "event_id", F.col("us").alias("t"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'view'")
    return rows.select("session", F.col("us").alias("start"), (F.col("us") + F.rint(F.col("value") * MINUTE).cast("long")).alias("stop"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'click'")
    return rows.select("session", F.col("us").alias("start"), (F.col("us") + HALF_HOUR).alias("stop"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'error'")
    return rows.select("session", F.col("us").alias("start"), (F.col("us") + 10 * MINUTE).alias("stop"))


def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("session").agg(F.min("us").alias("start"), F.max("us").alias("stop"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for label, rows in (("view", views), ("click", clicks), ("error", errors)):
        one = rows(spark, sf_dir).withColumn("label", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, idx, value, us): the events of a session, numbered from 0."""
    number = F.row_number().over(Window.partitionBy("session").orderBy("us", "event_id")) - 1
    return events(spark, sf_dir).select("session", number.cast("long").alias("idx"), "value", "us", "event_id", "event_type")


EV = "ev AS (SELECT event_id, CAST(user_id % 8 AS INTEGER) AS session, user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS us, value FROM events)"
VIEWS = f"a AS (SELECT session, us AS start, us + CAST(round_even(value * {MINUTE}, 0) AS BIGINT) AS stop FROM ev WHERE event_type = 'view')"
CLICKS = f"b AS (SELECT session, us AS start, us + {HALF_HOUR} AS stop FROM ev WHERE event_type = 'click')"
ERRORS = f"c AS (SELECT session, us AS start, us + {10 * MINUTE} AS stop FROM ev WHERE event_type = 'error')"
EXTENT = "ext AS (SELECT session, MIN(us) AS start, MAX(us) AS stop FROM ev GROUP BY session)"
SAMPLES = "sm AS (SELECT session, CAST(ROW_NUMBER() OVER (PARTITION BY session ORDER BY us, event_id) - 1 AS BIGINT) AS idx, value, us, event_id, event_type FROM ev)"
ALL = f"{EV}, {VIEWS}, {CLICKS}, {ERRORS}, {EXTENT}"


def islands(name: str, source: str, joined: str = "start <= m") -> str:
    """SQL for the merged periods of a source."""
    return (
        f"{name} AS (SELECT * FROM (SELECT session, MIN(start) AS start, MAX(stop) AS stop FROM (SELECT session, start, stop, SUM(CASE WHEN {joined} THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl "
        f"FROM (SELECT session, start, stop, MAX(stop) OVER (PARTITION BY session ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {source})) GROUP BY session, isl) WHERE stop > start)"
    )


def meet(name: str, a: str, b: str) -> str:
    """SQL for the pairwise overlaps of two sources."""
    return f"{name} AS (SELECT a1.session, GREATEST(a1.start, b1.start) AS start, LEAST(a1.stop, b1.stop) AS stop FROM {a} a1 JOIN {b} b1 ON a1.session = b1.session AND a1.start < b1.stop AND b1.start < a1.stop)"


def outside(name: str, merged: str) -> str:
    """SQL for what merged periods leave of all time."""
    return (
        f"{name} AS (SELECT session, stop AS start, COALESCE(LEAD(start) OVER (PARTITION BY session ORDER BY start), 9000000000000000) AS stop FROM {merged} "
        f"UNION ALL SELECT session, -9000000000000000, MIN(start) FROM {merged} GROUP BY session "
        f"UNION ALL SELECT s.session, -9000000000000000, 9000000000000000 FROM (SELECT DISTINCT session FROM ev) s WHERE s.session NOT IN (SELECT session FROM {merged}))"
    )
