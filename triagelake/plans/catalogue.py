"""The catalogue of named core queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelake.plans import code_queries, effect_queries, evaluation_queries, pipeline, stream_queries, text_queries
from triagelake.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk and verdict of every sample, from text and recovered resources to
    score."""
    resources = table(spark, sf_dir, "fas_resources").select("sample_id", "idx", "value").distinct()
    found = pipeline.recovered(table(spark, sf_dir, "fas_bytes"), resources)
    return pipeline.scores(table(spark, sf_dir, "samples"), extra=found)


def queries() -> dict:
    return {"sample_scores": flagship, **evaluation_queries.QUERIES, **text_queries.QUERIES, **effect_queries.QUERIES, **code_queries.QUERIES, **stream_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**evaluation_queries.SQL, **text_queries.SQL, **effect_queries.SQL, **code_queries.SQL, **stream_queries.SQL}
