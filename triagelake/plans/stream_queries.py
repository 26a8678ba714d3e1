"""Streaming queries over the events table, with the SQL of their result."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.session import table
from triagelake.streaming import watch


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def stream_windows(spark, sf_dir):
    """Hourly counts per event type from a stream."""
    return watch.drained(watch.windowed(_events(spark, sf_dir), "ts", "1 hour", None, "event_type"), "complete")


def stream_sliding(spark, sf_dir):
    """Two-hour windows every hour."""
    return watch.drained(watch.windowed(_events(spark, sf_dir), "ts", "2 hours", "1 hour", "event_type"), "complete")


def stream_once(spark, sf_dir):
    """Events of a stream without repeated deliveries, per type."""
    rows = watch.drained(watch.once_within(_events(spark, sf_dir), "event_id", "ts", "1 day"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_sliding, stream_once)}

SQL = {
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_sliding": """SELECT s AS start, s + INTERVAL 2 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total FROM (
 SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL""",
    "stream_once": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
}
