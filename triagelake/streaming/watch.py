"""Watching a folder: the batch operators over arriving files and events.

The stream is stateless per sample (a file arrives whole) except for what
needs time: deliveries of the same event are dropped within a watermark, and
counts are kept per window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.session import scratch, shared_dir
from triagelake.sources import lisp
from triagelake.sources.files import EXTENSIONS

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, root: str, per_trigger: int = 1_000) -> DataFrame:
    """Files below a folder as they arrive, as samples."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(root)
    text = F.decode("content", "ISO-8859-1")
    return files.select(F.regexp_extract("path", r"[^/\\]*$", 0).alias("sample_id"), "path", "modificationTime", text.alias("text"))


def arriving_facts(samples: DataFrame) -> DataFrame:
    """Fact rows of arriving scripts: the batch extraction, unchanged."""
    return lisp.facts(samples)


def each_batch(samples: DataFrame, sink: Callable[[DataFrame, int], None], name: str):
    """Run a batch function on every micro-batch; progress is kept in the
    shared folder, so a restart goes on where it was."""
    spark = samples.sparkSession
    return samples.writeStream.foreachBatch(sink).option("checkpointLocation", f"{shared_dir(spark)}/watch-{name}").trigger(availableNow=True).start()


def arriving_rows(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once_within(rows: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Deliveries of the same key within the watermark once."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed(rows: DataFrame, ts: str, size: str, slide: str | None, *by: str) -> DataFrame:
    """Counts and sums per tumbling or sliding window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, *by: str) -> DataFrame:
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input that is there now, as a table."""
    spark = stream.sparkSession
    path, at = scratch(spark, "drained"), scratch(spark, "drained-at")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
