"""Model records: keys, payloads, fused labels, and text for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.evaluation import delivered_once


def cache_key(*parts: Column) -> Column:
    """Digest of the parts joined by line ends; nulls count as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def json_object(text: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


PAYLOAD = "label string, verdict string, confidence double, reasoning string, summary string, functions array<string>"


def parsed(records: DataFrame, key: str, text: str) -> DataFrame:
    """Fields of a payload; a field given as text or as an object is text, an
    older field stands in for a missing one, broken payloads are null."""
    raw = json_object(F.col(text))
    v = F.try_parse_json(raw)
    as_text = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.try_variant_get(v, path, "variant").cast("string"))
    return records.select(
        key,
        v.isNotNull().alias("valid"),
        F.upper(F.coalesce(F.try_variant_get(v, "$.label", "string"), F.try_variant_get(v, "$.verdict", "string"))).alias("label"),
        F.try_variant_get(v, "$.confidence", "double").alias("confidence"),
        F.coalesce(as_text("$.summary"), as_text("$.reasoning")).alias("summary"),
        F.size(F.coalesce(F.try_variant_get(v, "$.functions", "array<string>"), F.array().cast("array<string>"))).alias("functions"),
    )


def hydrated(rows: DataFrame, cache: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fields that a row lacks, from the first cached record of its key."""
    c = cache.groupBy(key).agg(F.min_by(F.struct(*columns), "ts").alias("_c"))
    out = rows.join(c, key, "left").withColumn("cache_hit", F.col("_c").isNotNull())
    return out.select(*[F.coalesce(F.col(x), F.col(f"_c.{x}")).alias(x) if x in columns else F.col(x) for x in rows.columns], "cache_hit")


def first_labels(evals: DataFrame) -> DataFrame:
    """First record of each normalised sample path and model."""
    path = F.lower(F.translate("sample", "/", "\\"))
    rows = delivered_once(evals, "sample", "llm_model", "semantic_label", "semantic_confidence").where("semantic_label is not null")
    return rows.groupBy(F.regexp_replace(path, r"^(\.\\)+", "").alias("sample_key"), "llm_model").agg(
        F.min_by(F.struct("eval_id", "semantic_label", "semantic_confidence"), "eval_id").alias("r")
    ).select("sample_key", "llm_model", "r.*")


def prompt_text(effects: DataFrame, edges: DataFrame) -> DataFrame:
    """Behaviour of a sample as text: functions in order of name, each with
    its effects and calls."""
    e = effects.groupBy("sample_id", "fn").agg(F.array_sort(F.collect_set(F.format_string("  %s -> %s via %s", "effect_type", "target", "source"))).alias("e"))
    c = edges.groupBy("sample_id", F.col("caller").alias("fn")).agg(F.array_sort(F.collect_set(F.concat(F.lit("  calls "), "callee"))).alias("c"))
    none = F.array().cast("array<string>")
    per = e.join(c, ["sample_id", "fn"], "full")
    text = F.concat_ws("\n", F.concat(F.lit("function "), "fn"), F.concat(F.coalesce("e", none), F.coalesce("c", none)))
    blocks = per.select("sample_id", F.struct("fn", text.alias("t")).alias("b"))
    return blocks.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "\n\n").alias("prompt"))
