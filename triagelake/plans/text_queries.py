"""Queries over texts and recovered resources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import text as X
from triagelake.operators import records as N
from triagelake.plans.pipeline import once
from triagelake.session import staged, table
from triagelake.sources import bytecode as B
from triagelake.sources import containers as C
from triagelake.sources import lisp


def comment_free(spark, sf_dir):
    """Digest of each script without comments (the texts are long)."""
    s = table(spark, sf_dir, "samples").where("text is not null")
    return s.select("path", F.md5(X.strip_comments(F.col("text"))).alias("stripped"), F.length(X.strip_comments(F.col("text"))).cast("bigint").alias("n"))


def without_preamble(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("text is not null")
    t = X.drop_preamble(F.col("text"))
    return s.select("path", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("h"), X.looks_like_source(F.col("text")).alias("source_like"), X.has_compiled_header(F.col("text")).alias("compiled_header"))


def line_convergence(spark, sf_dir):
    """Lines of documents after the 4/16 rule."""
    rows = X.line_rows(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    kept = X.converge_rows(rows, "doc_id", "pos", "k")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("h"))


def word_convergence(spark, sf_dir):
    """The same rule over the first words of lines, which repeat more."""
    rows = X.line_rows(table(spark, sf_dir, "samples").where("text is not null").select("path", "text").distinct(), "path", "text")
    rows = rows.withColumn("head", F.regexp_extract("k", r"^\(?[A-Za-z:*-]*", 0))
    return X.converge_rows(rows, "path", "pos", "head").groupBy("path").agg(F.count(F.lit(1)).alias("kept"), F.sum("pos").alias("positions"))


def printable_runs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(X.printable_runs(F.col("text"))).alias("pos", "run"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.length("run")).alias("chars"), F.max("run").alias("last_run"))


def vba_sources(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("text is not null")
    return s.groupBy("input_type", X.is_vba(F.col("text")).alias("vba")).agg(F.count(F.lit(1)).alias("n"))


def vba_behaviours(spark, sf_dir):
    """Macro patterns in scripts and in documents, which quote some."""
    t = table(spark, sf_dir, "samples").select("path", "text").distinct().select(F.col("path").alias("sample_id"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "text")
    b = X.vba_behaviours(t.unionByName(d))
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("samples"), F.max("value").alias("last"))


def ioc_extract(spark, sf_dir):
    """Paths and addresses in documents, by class."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    found = F.regexp_extract_all("text", F.lit(r"(https?://[A-Za-z0-9./_-]+|[A-Za-z]:\\[A-Za-z0-9_.\\-]+|support/[A-Za-z0-9_./-]+)"), F.lit(1))
    rows = d.select("source", F.explode(found).alias("v"))
    kind = F.when(F.col("v").startswith("http"), "url").when(F.col("v").contains("\\"), "windows_path").otherwise("path")
    return rows.groupBy("source", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("different"))


def resource_summary(spark, sf_dir):
    r = table(spark, sf_dir, "fas_resources").distinct()
    return B.resource_summary(r).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("files"))


def summary_effects(spark, sf_dir):
    e = B.summary_effects(B.resource_summary(table(spark, sf_dir, "fas_resources").distinct()))
    return e.select("sample_id", "effect_type", "target", F.col("seq").cast("bigint").alias("seq"))


def compiled_streams(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("input_type = 'fas'").select("sample_id", "content").distinct()
    return C.compiled_files(s).groupBy("used_fallback", "problem").agg(F.count(F.lit(1)).alias("n"), F.sum("stream1_length").alias("code_bytes"))


def raw_strings(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("input_type in ('fas', 'vlx')").select("sample_id", "content").distinct()
    return s.select("sample_id", F.size(C.raw_strings(F.col("content"))).cast("bigint").alias("runs"))


def container_records(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("input_type = 'vlx'").select("sample_id", "content").distinct()
    return C.containers(s).select("sample_id", "idx", "name", "kind", "length", "digest")


def script_nodes(spark, sf_dir):
    f = lisp.facts(table(spark, sf_dir, "samples").transform(once))
    return f.where("fact = 'node'").groupBy(F.col("name").alias("op")).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("sample_id").alias("samples"), F.max("depth").alias("max_depth"))


def list_assignments(spark, sf_dir):
    """Assignments of lists that are mostly literals, per sample."""
    n = lisp.facts(table(spark, sf_dir, "samples").transform(once)).where("fact = 'node'")
    sets = n.where("name = 'SETQ' and depth = 0").select("sample_id", F.get("args", 0).text.alias("variable"), F.get("args", 1).child.alias("seq"))
    lists = n.where("name = 'LIST' and size(args) > 0").select("sample_id", "seq", (F.size(F.filter("args", lambda a: a["kind"].isin("number", "text"))) / F.size("args")).alias("share"))
    return sets.join(lists, ["sample_id", "seq"]).where("share > 0.8").select("sample_id", "variable", F.lit(0.8).alias("confidence"))


def guarded_branches(spark, sf_dir):
    """IF nodes with a direct look at the environment."""
    n = lisp.facts(table(spark, sf_dir, "samples").transform(once)).where("fact = 'node'").select("sample_id", "seq", "parent", "name", "fn", "line")
    n = staged(n)
    checks = n.where(F.lower("fn").isin("getenv", "sysvar", "getvar", "findfile")).select("sample_id", F.col("parent").alias("seq"))
    return n.where("name = 'IF'").join(checks, ["sample_id", "seq"], "left_semi").select("sample_id", "seq", "line", F.lit(0.7).alias("confidence"))


def json_payloads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_type = 'json'")
    return N.parsed(d, "doc_id", "text").groupBy("valid", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def cache_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", N.cache_key(F.col("source"), F.col("lang"), F.col("doc_type"), F.col("text")).alias("key"))


def first_labels(spark, sf_dir):
    return N.first_labels(table(spark, sf_dir, "eval_rows"))


def scalars(spark, sf_dir):
    """Scalar functions over file names."""
    s = table(spark, sf_dir, "samples")
    name = F.regexp_extract("path", r"[^/\\]*$", 0)
    return s.select(
        "path", name.alias("base"), F.regexp_extract(name, r"\.[^.]*$", 0).alias("ext2"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.replace("path", F.lit("/"), F.lit("\\"))).alias("path_key"), X.ellipsis(F.col("path"), 20).alias("short"), X.escape(F.concat(F.lit('"'), F.col("path"), F.lit("\\"))).alias("escaped"),
        F.regexp_replace("path", r"\s+", " ").alias("collapsed"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        comment_free, without_preamble, line_convergence, word_convergence, printable_runs, vba_sources, vba_behaviours, ioc_extract, resource_summary, summary_effects,
        compiled_streams, raw_strings, container_records,
        script_nodes, list_assignments, guarded_branches, json_payloads, event_props, cache_keys, first_labels, scalars,
    )
}

_HEAD = r"(?m)^[ \t\r]*\((?:" + "|".join(X.KNOWN_HEADS) + ")"
_STRIP = r"array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(regexp_replace(l, ';.*$', ''), '[ \t\r]+$', '')), chr(10))"


def _converge(rows: str, key: str, what: str) -> str:
    return f"""b AS ({rows}),
c AS (SELECT *, CASE WHEN lag({what}) OVER (PARTITION BY {key} ORDER BY pos) = {what} THEN 0 ELSE 1 END AS nw FROM b),
d AS (SELECT *, sum(nw) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY {key}, run ORDER BY pos) AS r FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY {key}, {what} ORDER BY pos) AS n FROM e WHERE r <= 4)"""


_TRIM = r"regexp_replace(line, '^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$', '', 'g')"
_CLASSES = r"""list_filter([
 CASE WHEN regexp_matches(lower(value), '^https?://[^\s"'']+') THEN 'url' END,
 CASE WHEN contains(lower(value), 'hkey_') AND contains(value, '\') THEN 'registry_key' END,
 CASE WHEN regexp_matches(lower(value), 'wscript|scripting\.|microsoft\.xml|msxml|adodb|scriptlet|wbemscripting|shell\.application|winhttp|xmlhttp') THEN 'com_object' END,
 CASE WHEN regexp_matches(lower(value), 'cmd\.exe|rundll32|regsvr32|wscript\.exe|powershell|mshta|certutil|bitsadmin|attrib ') THEN 'command' END,
 CASE WHEN regexp_matches(lower(value), '\.(lsp|fas|vlx|mnl|dcl|scr|dll|ocx|exe)\b') THEN 'file_path' END,
 CASE WHEN contains(value, '\') OR contains(value, '/') THEN 'path' END,
 CASE WHEN contains(value, '.') AND NOT starts_with(value, '[') AND length(value) > 3 THEN 'filename' END,
 CASE WHEN regexp_matches(value, '^\[(S::|VLR)') THEN 'reactor' END], lambda x: x IS NOT NULL)"""
_SUMMARY = f"s AS (SELECT DISTINCT sample_id, idx, value, unnest({_CLASSES}) AS class FROM fas_resources WHERE value IS NOT NULL)"
_PAIRS = {k: X.VBA_BEHAVIOURS[k].replace("'", "''") for k in X.VBA_BEHAVIOURS}
_BARE = r"""regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g')"""
_MACROS = " UNION ALL ".join(
    f"SELECT sample_id, '{k}' AS kind, unnest({x}) AS value FROM t" for k, x in (
        ("shell", f"list_transform(list_transform(list_zip(regexp_extract_all(text, '(?i){_PAIRS['shell']}', 1), regexp_extract_all(text, '(?i){_PAIRS['shell']}', 2)), lambda z: coalesce(nullif(z[1], ''), z[2])), lambda x: {_BARE})"),
        ("com_object", f"list_transform(regexp_extract_all(text, '(?i){_PAIRS['com_object']}', 1), lambda x: lower(x))"),
        ("registry", f"list_transform(regexp_extract_all(text, '(?i){_PAIRS['registry']}', 1), lambda x: left(x, {X.VBA_KEY_LENGTH}))"),
        *[(k, f"regexp_extract_all(text, '(?i){_PAIRS[k]}', 1)") for k in ("file_write", "file_read", "hook", "undefine")],
        *[(k, f"regexp_extract_all(text, '(?i){_PAIRS[k]}')") for k in ("url", "template", "autoload", "wmi", "mac", "save_as", "inject")],
        ("target", f"list_concat(CASE WHEN regexp_matches(text, '(?i){_PAIRS['template']}') THEN regexp_extract_all(text, '{X.VBA_TEMPLATE_PATH}', 1) ELSE [] END, CASE WHEN regexp_matches(text, '(?i){_PAIRS['autoload']}') THEN ['acaddoc.lsp'] ELSE [] END)"),
    )
)
_SIGNS = lambda ps: " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in ps)

SQL = {
    "comment_free": f"SELECT path, md5({_STRIP}) AS stripped, length({_STRIP}) AS n FROM samples WHERE text IS NOT NULL",
    "without_preamble": f"""SELECT path, length(t) AS n, md5(t) AS h, regexp_matches(left(text, 65536), '{_HEAD}') AS source_like, regexp_matches(left(text, 4096), '(?m)^[ \\t\\r]*(?:FAS4|; AutoCAD Binary File)') AS compiled_header
 FROM (SELECT *, CASE WHEN regexp_matches(text, '{_HEAD}') THEN regexp_extract(text, '(?s)(?:(?m)^[ \\t\\r]*\\((?:{"|".join(X.KNOWN_HEADS)})).*\\z') ELSE text END AS t FROM samples WHERE text IS NOT NULL)""",
    "line_convergence": f"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM a),
{_converge(f"SELECT *, {_TRIM} AS k FROM x WHERE {_TRIM} <> ''", "doc_id", "k")}
SELECT doc_id, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY pos)) AS h FROM f WHERE n <= 16 GROUP BY doc_id""",
    "word_convergence": f"""WITH a AS (SELECT DISTINCT path, text FROM samples WHERE text IS NOT NULL), a2 AS (SELECT path, string_split(text, chr(10)) AS l FROM a), x AS (SELECT path, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM a2),
{_converge(f"SELECT *, regexp_extract({_TRIM}, '^[(]?[A-Za-z:*-]*') AS head FROM x WHERE {_TRIM} <> ''", "path", "head")}
SELECT path, count(*) AS kept, sum(pos)::BIGINT AS positions FROM f WHERE n <= 16 GROUP BY path""",
    "printable_runs": """SELECT doc_id, count(*) AS runs, sum(length(run))::BIGINT AS chars, max(run) AS last_run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[ -~]{4,256}')) AS run FROM documents) GROUP BY doc_id""",
    "vba_sources": f"""SELECT input_type, v >= 2 AND v > l AS vba, count(*) AS n FROM (SELECT input_type, {_SIGNS(X.VBA_SIGNS)} AS v, {_SIGNS(X.LISP_SIGNS)} AS l FROM samples WHERE text IS NOT NULL) GROUP BY ALL""",
    "vba_behaviours": f"""WITH t AS (SELECT DISTINCT path AS sample_id, text FROM samples UNION ALL SELECT doc_id::VARCHAR, text FROM documents), m AS ({_MACROS})
SELECT kind, count(*) AS n, count(DISTINCT sample_id) AS samples, max(value) AS last FROM m WHERE value <> '' GROUP BY kind""",
    "raw_strings": """SELECT sample_id, len(regexp_extract_all(regexp_replace(hex(content), '(..)', '\\1 ', 'g'), '(?:(?:[2-6][0-9A-F]|7[0-9A-E]) ){4,256}')) AS runs FROM (SELECT DISTINCT sample_id, content FROM samples WHERE input_type IN ('fas', 'vlx'))""",
    "ioc_extract": r"""SELECT source, CASE WHEN starts_with(v, 'http') THEN 'url' WHEN contains(v, '\') THEN 'windows_path' ELSE 'path' END AS kind, count(*) AS n, count(DISTINCT v) AS different
 FROM (SELECT source, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+|[A-Za-z]:\\[A-Za-z0-9_.\\-]+|support/[A-Za-z0-9_./-]+')) AS v FROM documents) GROUP BY ALL""",
    "resource_summary": f"WITH {_SUMMARY} SELECT class, count(*) AS n, count(DISTINCT sample_id) AS files FROM s GROUP BY class",
    "summary_effects": f"""WITH {_SUMMARY}, o AS (SELECT sample_id, class, lower(value) AS low, arg_min(value, idx) AS value, min(idx) AS idx FROM s WHERE class IN ('url', 'com_object', 'registry_key', 'command', 'file_path') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, class ORDER BY idx) AS k, count(*) OVER (PARTITION BY sample_id, class) AS n FROM o)
SELECT sample_id, CASE class WHEN 'url' THEN 'network_connect' WHEN 'com_object' THEN 'com_create' WHEN 'registry_key' THEN 'registry_modify' WHEN 'command' THEN 'process_create' ELSE 'file_write' END AS effect_type,
 value AS target, idx::BIGINT AS seq FROM r WHERE k <= CASE class WHEN 'url' THEN 8 WHEN 'file_path' THEN 6 ELSE 4 END AND (class <> 'url' OR n <= 8)""",
    "event_props": "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "cache_keys": "SELECT doc_id, sha256(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(doc_type, '') || chr(10) || coalesce(text, '')) AS key FROM documents",
    "first_labels": r"""WITH e AS (SELECT eval_id, arg_min(struct_pack(v := sample), ingest_ts).v AS sample, arg_min(struct_pack(v := llm_model), ingest_ts).v AS llm_model, arg_min(struct_pack(v := semantic_label), ingest_ts).v AS semantic_label,
 arg_min(struct_pack(v := semantic_confidence), ingest_ts).v AS semantic_confidence FROM eval_rows GROUP BY eval_id)
SELECT regexp_replace(lower(replace(sample, '/', '\')), '^(\.\\)+', '') AS sample_key, llm_model, min(eval_id) AS eval_id, arg_min(semantic_label, eval_id) AS semantic_label, arg_min(semantic_confidence, eval_id) AS semantic_confidence
FROM e WHERE semantic_label IS NOT NULL GROUP BY 1, 2""",
    "scalars": r"""SELECT path, base, regexp_extract(base, '\.[^.]*$') AS ext2, regexp_replace(base, '\.[^.]*$', '') AS stem, lower(replace(path, '/', '\')) AS path_key,
 CASE WHEN length(path) > 20 THEN left(path, 17) || '...' ELSE path END AS short, replace(replace('"' || path || '\', '\', '\\'), '"', '\"') AS escaped, regexp_replace(path, '\s+', ' ', 'g') AS collapsed
FROM (SELECT *, regexp_extract(path, '[^/\\]*$') AS base FROM samples)""",
}
