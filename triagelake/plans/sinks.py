"""Sinks: batch reports as CSV and JSON, exports, caches, decoded sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def formatted(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns as text with a fixed number of digits."""
    f = lambda c: F.format_string(f"%.{digits}f", F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return rows.select(*[f(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, numbers as in the batch report."""
    formatted(rows).write.option("header", True).mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def baseline_export(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Export rows: texts with their split, null where none was assigned."""
    return samples.join(splits.select("sample", "split"), "sample", "left").select("sample", "label", "input_type", "split", "text", "semantic", "rule_ids_text")


def write_cache(records: DataFrame, path: str) -> None:
    """Append model records to a columnar cache, bucketed by key prefix so a
    look-up reads one folder."""
    records.withColumn("prefix", F.substring("key", 1, 2)).write.partitionBy("prefix").mode("append").parquet(path)


def modules(lines: DataFrame, marker: str = r"^;; record ", key: str = "sample_id") -> DataFrame:
    """Modules of a decoded container: lines between record marks."""
    w = Window.partitionBy(key).orderBy("pos")
    numbered = lines.withColumn("module", F.sum(F.col("line").rlike(marker).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return numbered.where("module > 0").groupBy(key, "module").agg(body.alias("source"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))
