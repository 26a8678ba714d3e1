"""Sample scans, manifests and metadata files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import text as X

# fixed values: extensions that a scan takes
EXTENSIONS = ("lsp", "fas", "vlx")


def input_type(ext: Column, text: Column) -> Column:
    """Type by extension, corrected by content: a compiled header or a macro
    may stand under any name."""
    e = F.lower(F.regexp_replace(ext, r"^\.", ""))
    compiled = X.has_compiled_header(text)
    return (
        F.when(e == "vlx", "vlx").when((e == "fas") & (compiled | ~X.looks_like_source(text)), "fas").when(compiled, "fas").when(X.is_vba(text), "lsp-vba").otherwise("lsp")
    )


def scan(spark: SparkSession, root: str, recursive: bool = True, extensions=EXTENSIONS) -> DataFrame:
    """Files below a folder as samples; extensions regardless of case, files
    that can't be read are left out."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    )
    base = F.regexp_extract("path", r"[^/\\]*$", 0)
    text = F.decode("content", "ISO-8859-1")
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    kind = input_type(F.regexp_extract(base, r"\.[^.]*$", 0), text)
    rows = files.select(base.alias("sample_id"), "path", F.regexp_extract(base, r"\.[^.]*$", 0).alias("ext"), kind.alias("input_type"), "content", F.col("length").alias("n_bytes"), F.coalesce(utf8, text).alias("_t"))
    return rows.withColumn("text", F.when(F.col("input_type").isin("lsp", "lsp-vba"), F.col("_t"))).drop("_t")


def csv_manifest(spark: SparkSession, path: str, column: str = "sample") -> DataFrame:
    """Distinct trimmed values of a column, whose name may be in any case."""
    rows = spark.read.option("header", True).csv(path)
    name = next((c for c in rows.columns if c.strip().lower().lstrip("﻿") == column), None)
    if name is None:
        raise ValueError(f"no column {column} in {path}")
    return rows.select(F.trim(F.col(f"`{name}`")).alias("sample")).where("sample <> ''").distinct().orderBy("sample")


def line_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of a text file, without byte-order mark, quotes, header."""
    line = F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"^[\"']+|[\"',]+$", ""))
    return spark.read.text(path).select(line.alias("sample")).where("sample <> '' and lower(sample) <> 'sample'").distinct().orderBy("sample")


def manifest(spark: SparkSession, csv_path: str | None, fallback: str | None, root: str | None, refresh: bool = False) -> DataFrame:
    """Samples to work on: a fresh scan, else a manifest, else an older one,
    else a scan."""
    if not refresh:
        for path in filter(None, (csv_path, fallback)):
            if _exists(spark, path):
                try:
                    return csv_manifest(spark, path)
                except ValueError:
                    return line_manifest(spark, path)
    if root is None:
        raise ValueError("neither a manifest nor a folder to scan")
    return scan(spark, root).select(F.col("path").alias("sample")).orderBy("sample")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


METADATA = "md5 string, sha1 string, sha256 string, label string, names array<string>, positives int"


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata files of one JSON object each, one row per hash; files that
    are no JSON give nothing."""
    text = spark.read.text(folder, wholetext=True)
    rows = text.select(F.from_json("value", METADATA).alias("m")).select("m.*")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(F.trim(k)).alias("key")) for k in ("sha256", "sha1", "md5")])
    return rows.select("label", "names", "positives", F.explode(each).alias("k")).select("k.*", "label", "names", "positives").where("key is not null and key <> ''")


def json_records(spark: SparkSession, folder: str, schema: str, model: str | None = None) -> DataFrame:
    """Cached model records, first per normalised sample path."""
    rows = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("r")).select("file", "r.*")
    if model is not None:
        rows = rows.where(F.col("model") == model)
    key = F.lower(F.replace("sample", F.lit("/"), F.lit("\\")))
    return rows.where("sample is not null").groupBy(key.alias("sample_key")).agg(F.min_by(F.struct(*[c for c in rows.columns]), "file").alias("r")).select("sample_key", "r.*")


def relocate(missing: DataFrame, present: DataFrame) -> DataFrame:
    """For paths that are gone, the file of the same name; of several the one
    whose path shares most of the folders, then the first."""
    name = lambda c: F.lower(F.regexp_extract(c, r"[^/\\]*$", 0))
    parts = lambda c: F.split(F.lower(F.translate(c, "\\", "/")), "/")
    pairs = missing.select("path", name("path").alias("n")).join(present.select(F.col("path").alias("candidate"), name("path").alias("n")), "n")
    shared = F.size(F.array_intersect(parts("path"), parts("candidate")))
    return pairs.groupBy("path").agg(F.min_by("candidate", F.struct((-shared).alias("s"), "candidate")).alias("found"))


def defaults(given: dict, base: dict) -> dict:
    """A configuration with defaults for what is not given, level by level."""
    out = dict(base)
    for k, v in (given or {}).items():
        out[k] = defaults(v, base[k]) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return out
