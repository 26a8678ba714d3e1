"""Queries over evaluation rows and the experiment table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import vocabulary as V
from triagelake.operators import evaluation as A
from triagelake.operators import scoring as S
from triagelake.session import table


def eval_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_rows")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_stat")


def confusion_matrix(spark, sf_dir):
    return A.eval_confusion(eval_base(spark, sf_dir))


def confusion_by_type(spark, sf_dir):
    return A.eval_confusion(eval_base(spark, sf_dir), by_type=True)


def timing_stats(spark, sf_dir):
    return A.timing(eval_base(spark, sf_dir))


def verdict_counts(spark, sf_dir):
    rows = A.delivered_once(eval_base(spark, sf_dir), "verdict", "final_verdict")
    return rows.groupBy("verdict", "final_verdict").agg(F.count(F.lit(1)).alias("n"))


def eval_report(spark, sf_dir):
    return A.report(eval_base(spark, sf_dir))


EVAL_TEXT = (
    "sample", "input_type", "verdict", "rule_verdict", "final_verdict", "semantic_label", "fusion_summary", "llm_provider", "llm_model", "decision_model", "error",
)
EVAL_WHOLE = ("prompt_tokens", "completion_tokens", "techniques", "rule_count")
EVAL_FLAGS = ("decision_agreement", "cache_hit")
EVAL_NUMBERS = ("semantic_confidence", "llm_latency_ms", "p_malicious", "risk", "threshold", "attack_risk", *A.STAGES)


def eval_csv(spark, sf_dir):
    """The 31 columns of the batch CSV with its number format: nulls are
    empty, 0 or false, what is no number is 0."""
    rows = A.delivered_once(eval_base(spark, sf_dir), *EVAL_TEXT, *EVAL_WHOLE, *EVAL_FLAGS, *EVAL_NUMBERS)
    number = lambda c: F.format_string("%.4f", F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c))).alias(c)
    return rows.select(
        "eval_id", *[F.coalesce(c, F.lit("")).alias(c) for c in EVAL_TEXT], *[F.coalesce(c, F.lit(0)).cast("string").alias(c) for c in EVAL_WHOLE],
        *[F.coalesce(c, F.lit(False)).cast("string").alias(c) for c in EVAL_FLAGS], *[number(c) for c in EVAL_NUMBERS],
    )


def verdict_fusion(spark, sf_dir):
    rows = A.delivered_once(eval_base(spark, sf_dir), "rule_verdict", "risk", "threshold", "semantic_label", "semantic_confidence", "verdict")
    rows = rows.where(~F.col("verdict").isin(*A.FAILED))
    v, why = S.fused_verdict(F.col("rule_verdict"), F.col("risk"), F.col("threshold"), F.col("semantic_label"), F.coalesce("semantic_confidence", F.lit(0.0)))
    return rows.select("eval_id", v.alias("fused"), why.alias("reason"))


def llm_only(spark, sf_dir):
    """A model's labels alone against ground truth, with its totals; hesitant
    labels count as not malicious."""
    rows = A.delivered_once(eval_base(spark, sf_dir), "sample", "semantic_label", "prompt_tokens", "completion_tokens", "llm_latency_ms", "llm_model")
    rows = rows.where("semantic_label is not null").select("*", A.is_benign(F.col("sample")).alias("benign"))
    counts = A.confusion(rows, ~F.col("benign"), F.col("semantic_label") == "MALICIOUS", F.col("llm_model"))
    totals = rows.groupBy("llm_model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.avg("llm_latency_ms"), 3).alias("avg_latency_ms")
    )
    return counts.join(totals, "llm_model")


def score_fusion(spark, sf_dir):
    """Mean of rule risk and label score, against the threshold."""
    rows = A.delivered_once(eval_base(spark, sf_dir), "risk", "threshold", "semantic_label", "semantic_confidence", "verdict")
    rows = rows.where(~F.col("verdict").isin(*A.FAILED) & F.col("semantic_label").isNotNull())
    score = A.label_score(F.col("semantic_label"), F.col("semantic_confidence"))
    fused = (F.col("risk") + score) / 2
    return rows.select("eval_id", F.round(score, 6).alias("label_score"), F.round(fused, 6).alias("fused_score"), F.when(fused >= F.col("threshold"), "MALICIOUS").otherwise("BENIGN").alias("fused"))


def cache_split(spark, sf_dir):
    """Evaluations of samples that a model has labelled, and of the others."""
    rows = A.delivered_once(eval_base(spark, sf_dir), "sample", "semantic_label")
    path = F.regexp_replace(F.translate("sample", "\\", "/"), r"^(\./)+", "")
    counts = rows.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count("semantic_label").alias("labelled"))
    side = F.when(F.col("labelled") > 0, "hit").otherwise("miss")
    return counts.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("evaluations"))


def replay_scores(spark, sf_dir):
    return A.replay(stats(spark, sf_dir))


def grid_search(spark, sf_dir):
    return A.grid_search(stats(spark, sf_dir))


def ablations(spark, sf_dir):
    return A.ablations(stats(spark, sf_dir))


def rule_multipliers(spark, sf_dir):
    return A.coordinate_descent(stats(spark, sf_dir))


def stratified_split(spark, sf_dir):
    return A.stratified_split(stats(spark, sf_dir))


def family_split(spark, sf_dir):
    return A.family_split(stats(spark, sf_dir))


def source_split(spark, sf_dir):
    return A.source_split(stats(spark, sf_dir))


def source_groups(spark, sf_dir):
    return stats(spark, sf_dir).groupBy(A.source_key(F.col("sample")).alias("source")).agg(F.count(F.lit(1)).alias("records"))


def content_digests(spark, sf_dir):
    return A.digests(table(spark, sf_dir, "samples"))


def lookup_priority(spark, sf_dir):
    s = stats(spark, sf_dir)
    keys = [(k, F.trim(k)) for k in ("sha256", "sha1", "md5")]
    return A.priority_lookup(s, "stat_id", keys, A.stat_index(s))


def family_vote(spark, sf_dir):
    return A.family_vote(stats(spark, sf_dir))


def family_recall(spark, sf_dir):
    return A.family_recall(stats(spark, sf_dir))


def metadata_coverage(spark, sf_dir):
    return A.coverage(stats(spark, sf_dir))


def mask_runs(spark, sf_dir):
    """Masking of rules: what is left of matched rules and their severity."""
    hits = stats(spark, sf_dir).select(F.explode("matched_rules").alias("r"))
    tokens = hits.groupBy(F.col("r.id").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.coalesce("r.severity", F.lit(0.0)) * 10000).cast("bigint")).cast("double").alias("total"))
    return A.mask_runs(tokens)


def _symbols(spark, sf_dir):
    a = table(spark, sf_dir, "fas_bytes").select("sample_id", F.explode("symbols").alias("item"))
    b = table(spark, sf_dir, "fas_resources").where("kind = 'symbol' and value is not null").select("sample_id", F.col("value").alias("item"))
    return a.where("item is not null"), b


def set_compare(spark, sf_dir):
    return A.set_compare(*_symbols(spark, sf_dir), "sample_id")


def set_summary(spark, sf_dir):
    return A.set_summary(A.set_compare(*_symbols(spark, sf_dir), "sample_id"))


def pair_strict(spark, sf_dir):
    return A.strict_pairs(table(spark, sf_dir, "samples"))


def pair_overlap(spark, sf_dir):
    """Compiled files and the script sources that share most of their symbols,
    best three each."""
    _, symbols = _symbols(spark, sf_dir)
    files = symbols.select(F.col("sample_id").alias("item"), F.lower("item").alias("token"))
    s = table(spark, sf_dir, "samples").where("text is not null")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z][a-z0-9_:*<>-]+)"), F.lit(1)))
    return A.overlap_pairs(files, s.select(F.col("sample_id").alias("item"), F.explode(words).alias("token")))


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, confusion_by_type, timing_stats, verdict_counts, eval_report, eval_csv, verdict_fusion, llm_only, score_fusion, cache_split,
        replay_scores, grid_search, ablations, rule_multipliers, stratified_split, family_split, source_split, source_groups, content_digests,
        lookup_priority, family_vote, family_recall, metadata_coverage, mask_runs, set_compare, set_summary, pair_strict, pair_overlap,
    )
}


def _once(*columns: str) -> str:
    picks = ", ".join(f"arg_min(struct_pack(v := {c}), ingest_ts).v AS {c}" for c in columns)
    return f"(SELECT eval_id, {picks} FROM eval_rows GROUP BY eval_id)"


_BENIGN = r"regexp_extract(sample, '[^/\\]*$') LIKE 'white\_%' ESCAPE '\'"
_RATES = """round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS tpr,
 round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS fnr,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def _counts(actual: str, predicted: str) -> str:
    return f"count_if(({actual}) AND ({predicted})) AS tp, count_if(NOT ({actual}) AND ({predicted})) AS fp, count_if(NOT ({actual}) AND NOT ({predicted})) AS tn, count_if(({actual}) AND NOT ({predicted})) AS fn"


_FLOOR = "CASE r.id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.RISK_FLOORS.items()) + " ELSE 0.0 END"
_EVIDENCE = f"""e AS (
 SELECT stat_id, label = 'MALICIOUS' AS m, coalesce(rule_evidence, 0) AS r, coalesce(attack_evidence, 0) AS a, coalesce(feature_evidence, 0) AS f,
  coalesce(formal_evidence, 0) AS g, coalesce(context_score, 0) AS c,
  coalesce(list_max(list_transform(matched_rules, lambda r: ({_FLOOR})::DOUBLE)), 0.0) AS fl FROM sample_stat)"""


def _risk_sql(r: str, a: str, f: str, g: str, slope: str = "4.0", factor: str = "1.0", formal_on: bool = True) -> str:
    rest = f"(({r}) + ({a}) + ({f}))"
    scale = f"(CASE WHEN e.g <= 0 THEN ({rest} + ({g})) / {rest} ELSE 1.0 END)" if formal_on else "1.0"
    gw = f"(CASE WHEN e.g <= 0 THEN 0.0 ELSE ({g}) END)" if formal_on else f"({g})"
    x = f"({scale} * ({r}) * e.r + {scale} * ({a}) * e.a + {scale} * ({f}) * e.f + {gw} * e.g)"
    s = f"(1.0::DOUBLE / (1.0 + exp(-({slope}) * ({x} - 0.5))))"
    return f"greatest(CASE WHEN e.c > 0.7 THEN least(1.0, {s} * 1.2) ELSE {s} END, e.fl * ({factor}))"


_GRID = """g AS (
 SELECT row_number() OVER (ORDER BY i, j, k, l, n, o) - 1 AS candidate, * FROM (
 SELECT * FROM (SELECT unnest(range(4)) AS i, unnest([0.25, 0.30, 0.35, 0.40]::DOUBLE[]) AS w_rule),
 (SELECT unnest(range(3)) AS j, unnest([0.20, 0.25, 0.30]::DOUBLE[]) AS w_attack), (SELECT unnest(range(3)) AS k, unnest([0.20, 0.25, 0.30]::DOUBLE[]) AS w_feature),
 (SELECT unnest(range(4)) AS l, unnest([3.0, 4.0, 5.0, 6.0]::DOUBLE[]) AS slope), (SELECT unnest(range(5)) AS n, unnest([0.45, 0.50, 0.55, 0.60, 0.65]::DOUBLE[]) AS threshold),
 (SELECT unnest(range(3)) AS o, unnest([0.9, 1.0, 1.1]::DOUBLE[]) AS factor)) WHERE 1.0::DOUBLE - w_rule - w_attack - w_feature BETWEEN 0.05::DOUBLE AND 0.30::DOUBLE)"""

_DULL = ", ".join(f"'{x}'" for x in A.GENERIC_PARTS)
_PLAIN = lambda x: f"coalesce(NOT regexp_matches({x}, '^[0-9a-f]{{16,}}$') AND {x} NOT IN ({_DULL}), false)"
_ENDS = "regexp_replace(lower(regexp_extract(sample, '[^/\\\\]*$')), '\\.[^.]*$', '')"
for _end in ("acad", "acaddoc", "mnl", "dcl"):
    _ENDS = f"regexp_replace({_ENDS}, '\\.{_end}$', '')"
_SOURCES = f"""sa AS (SELECT stat_id, label, trim(regexp_replace({_ENDS}, '^white_', '')) AS base FROM sample_stat),
sb AS (SELECT *, list_filter(string_split_regex(base, '[_\\- .()\\[\\]{{}}+]'), lambda x: trim(x) <> '' AND x <> 'white') AS parts FROM sa),
sc AS (SELECT *, list_filter(parts, lambda x: x NOT IN ({_DULL}))[1] AS p1 FROM sb), sd AS (SELECT *, list_position(parts, p1) AS k FROM sc), se AS (SELECT *, parts[k + 1] AS p2, parts[k + 2] AS p3 FROM sd),
so AS (SELECT stat_id, label, coalesce(CASE WHEN p1 IS NULL THEN NULL WHEN regexp_matches(p1, '^[0-9a-f]{{16,}}$') THEN CASE WHEN {_PLAIN('p2')} THEN CASE WHEN {_PLAIN('p3')} THEN 'src:' || p2 || '_' || p3 ELSE 'src:' || p2 END ELSE 'hash:' || left(p1, 16) END
 WHEN {_PLAIN('p2')} THEN 'src:' || p1 || '_' || p2 ELSE 'src:' || p1 END, 'sample:' || base) AS source FROM se)"""

SQL = {
    "confusion_matrix": f"""SELECT tp, fp, tn, fn, {_RATES} FROM (SELECT {_counts(f'NOT ({_BENIGN})', "verdict = 'MALICIOUS'")} FROM {_once('sample', 'verdict')} WHERE verdict NOT IN ('TIMEOUT', 'ERROR'))""",
    "confusion_by_type": f"""SELECT lower(input_type) AS input_type, count(*) AS rows, count_if(verdict = 'MALICIOUS' AND NOT ({_BENIGN})) AS tp, count_if(verdict = 'MALICIOUS' AND {_BENIGN}) AS fp
 FROM {_once('sample', 'verdict', 'input_type')} WHERE verdict NOT IN ('TIMEOUT', 'ERROR') GROUP BY ROLLUP (lower(input_type))""",
    "timing_stats": f"""SELECT stage, count(*) AS n, round(avg(ms), 3) AS avg_ms, round(median(ms), 6) AS median_ms, round(max(ms), 6) AS max_ms
 FROM (UNPIVOT (SELECT {', '.join(A.STAGES)} FROM {_once('verdict', *A.STAGES)} WHERE verdict NOT IN ('TIMEOUT', 'ERROR')) ON {', '.join(A.STAGES)} INTO NAME stage VALUE ms)
 WHERE ms IS NOT NULL AND isfinite(ms) AND ms >= 0 AND ms < 1e300 GROUP BY stage""",
    "verdict_counts": f"SELECT verdict, final_verdict, count(*) AS n FROM {_once('verdict', 'final_verdict')} GROUP BY ALL",
    "eval_report": f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY verdict IN ('TIMEOUT', 'ERROR'), coalesce(risk, 0) DESC, sample, eval_id) AS position, eval_id, sample, verdict, risk
 FROM {_once('sample', 'verdict', 'risk')}) WHERE position <= 100""",
    "eval_csv": f"""SELECT eval_id, {', '.join([f"coalesce({c}, '') AS {c}" for c in EVAL_TEXT] + [f"coalesce({c}, 0)::VARCHAR AS {c}" for c in EVAL_WHOLE] + [f"coalesce({c}, false)::VARCHAR AS {c}" for c in EVAL_FLAGS]
 + [f"printf('%.4f', CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0::DOUBLE ELSE {c} END) AS {c}" for c in EVAL_NUMBERS])} FROM {_once(*EVAL_TEXT, *EVAL_WHOLE, *EVAL_FLAGS, *EVAL_NUMBERS)}""",
    "verdict_fusion": f"""SELECT eval_id, CASE WHEN coalesce(semantic_label, '') IN ('', rule_verdict) THEN rule_verdict WHEN rule_verdict = 'MALICIOUS' AND risk >= threshold + 0.15::DOUBLE THEN 'MALICIOUS'
 WHEN rule_verdict = 'BENIGN' AND semantic_label = 'MALICIOUS' AND semantic_confidence >= 0.9::DOUBLE AND risk >= threshold * 0.6::DOUBLE THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS fused,
 CASE WHEN coalesce(semantic_label, '') = '' THEN 'rule-only' WHEN semantic_label = rule_verdict THEN 'agree' WHEN rule_verdict = 'MALICIOUS' AND risk >= threshold + 0.15::DOUBLE THEN 'strong-rule'
 WHEN rule_verdict = 'BENIGN' AND semantic_label = 'MALICIOUS' AND semantic_confidence >= 0.9::DOUBLE AND risk >= threshold * 0.6::DOUBLE THEN 'semantic-escalation' ELSE 'rule-llm-disagreement' END AS reason
 FROM {_once('rule_verdict', 'risk', 'threshold', 'semantic_label', 'semantic_confidence', 'verdict')} WHERE verdict NOT IN ('TIMEOUT', 'ERROR')""",
    "llm_only": f"""SELECT llm_model, tp, fp, tn, fn, {_RATES}, prompt_tokens, completion_tokens, avg_latency_ms FROM (
 SELECT llm_model, {_counts(f'NOT ({_BENIGN})', "semantic_label = 'MALICIOUS'")}, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(avg(llm_latency_ms), 3) AS avg_latency_ms
 FROM {_once('sample', 'semantic_label', 'prompt_tokens', 'completion_tokens', 'llm_latency_ms', 'llm_model')} WHERE semantic_label IS NOT NULL AND llm_model IS NOT NULL GROUP BY llm_model)""",
    "score_fusion": f"""SELECT eval_id, round(s, 6) AS label_score, round((risk + s) / 2, 6) AS fused_score, CASE WHEN (risk + s) / 2 >= threshold THEN 'MALICIOUS' ELSE 'BENIGN' END AS fused FROM (
 SELECT *, CASE semantic_label WHEN 'MALICIOUS' THEN 0.5::DOUBLE + 0.5::DOUBLE * least(greatest(coalesce(semantic_confidence, 0), 0), 1) WHEN 'BENIGN' THEN 0.5::DOUBLE - 0.5::DOUBLE * least(greatest(coalesce(semantic_confidence, 0), 0), 1) ELSE 0.5 END AS s
 FROM {_once('risk', 'threshold', 'semantic_label', 'semantic_confidence', 'verdict')} WHERE verdict NOT IN ('TIMEOUT', 'ERROR') AND semantic_label IS NOT NULL)""",
    "cache_split": f"""SELECT CASE WHEN l > 0 THEN 'hit' ELSE 'miss' END AS side, count(*) AS samples, sum(n)::BIGINT AS evaluations FROM (
 SELECT regexp_replace(replace(sample, '\\', '/'), '^(\\./)+', '') AS path, count(*) AS n, count(semantic_label) AS l FROM {_once('sample', 'semantic_label')} GROUP BY 1) GROUP BY 1""",
    "replay_scores": f"WITH {_EVIDENCE} SELECT stat_id, round(x, 6) AS risk, CASE WHEN x >= 0.5 THEN 'MALICIOUS' ELSE 'BENIGN' END AS verdict FROM (SELECT stat_id, {_risk_sql('0.30', '0.25', '0.25', '0.20')} AS x FROM e)",
    "grid_search": f"""WITH {_EVIDENCE}, {_GRID}, h AS (
 SELECT g.candidate, e.m, round({_risk_sql('w_rule', 'w_attack', 'w_feature', '1.0::DOUBLE - w_rule - w_attack - w_feature', 'slope', 'factor')}, 9) >= threshold AS hit FROM e, g
), k AS (SELECT candidate, {_counts('m', 'hit')} FROM h GROUP BY candidate), m AS (SELECT *, {_RATES} FROM k)
SELECT g.candidate, w_rule, w_attack, w_feature, 1.0::DOUBLE - w_rule - w_attack - w_feature AS w_formal, slope, threshold, factor, tp, fp, tn, fn, f1, accuracy, fpr,
 row_number() OVER (ORDER BY fpr <= 0.03 DESC, f1 DESC, accuracy DESC, fpr, (w_rule = 0.30::DOUBLE AND w_attack = 0.25::DOUBLE AND w_feature = 0.25::DOUBLE AND slope = 4.0 AND threshold = 0.5 AND factor = 1.0) DESC, g.candidate) AS position
FROM g JOIN m USING (candidate)""",
    "ablations": f"""WITH {_EVIDENCE}, h AS (
 SELECT 'Feature-Only' AS variant, m, round({_risk_sql('0.0', '0.0', '1.0', '0.0', factor='0.0', formal_on=False)}, 9) >= 0.5 AS hit FROM e UNION ALL
 SELECT 'Rule+ATT&CK Only', m, round({_risk_sql('0.3::DOUBLE/0.55::DOUBLE', '0.25::DOUBLE/0.55::DOUBLE', '0.0', '0.0', factor='0.0', formal_on=False)}, 9) >= 0.5 FROM e UNION ALL
 SELECT 'No-Floor', m, round({_risk_sql('0.30', '0.25', '0.25', '0.20', factor='0.0')}, 9) >= 0.5 FROM e UNION ALL
 SELECT 'No-Formal', m, round({_risk_sql('0.3::DOUBLE/0.8::DOUBLE', '0.25::DOUBLE/0.8::DOUBLE', '0.25::DOUBLE/0.8::DOUBLE', '0.0', formal_on=False)}, 9) >= 0.5 FROM e UNION ALL
 SELECT 'Full', m, round({_risk_sql('0.30', '0.25', '0.25', '0.20')}, 9) >= 0.5 FROM e
) SELECT variant, tp, fp, tn, fn, {_RATES} FROM (SELECT variant, {_counts('m', 'hit')} FROM h GROUP BY variant)""",
    "stratified_split": """SELECT stat_id, label, CASE WHEN r <= greatest(least(round(n * 0.55), n - 1), least(1, n)) THEN 'dev' ELSE 'test' END AS split FROM (
 SELECT stat_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('20260416|' || stat_id)) AS r, count(*) OVER (PARTITION BY label) AS n FROM sample_stat)""",
    "family_split": """WITH r AS (SELECT stat_id, coalesce(lower(trim(family)), '#' || stat_id) AS family FROM sample_stat),
g AS (SELECT family, count(*) AS n, md5('20260416|' || family) AS h FROM r GROUP BY family),
p AS (SELECT family, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT stat_id, CASE WHEN before < (SELECT count(*) FROM r) * 0.55::DOUBLE THEN 'dev' ELSE 'test' END AS split FROM r JOIN p USING (family)""",
    "content_digests": "SELECT sample_id, path, md5(content) AS md5, sha1(content) AS sha1, sha256(content) AS sha256 FROM samples",
    "lookup_priority": """WITH l AS (SELECT stat_id, unnest([{'p': 0, 'm': 'sha256', 'k': lower(trim(sha256))}, {'p': 1, 'm': 'sha1', 'k': lower(trim(sha1))}, {'p': 2, 'm': 'md5', 'k': lower(trim(md5))}]) AS x FROM sample_stat),
i AS (SELECT x.k AS k, min(stat_id) AS value FROM l WHERE x.k IS NOT NULL GROUP BY 1)
SELECT stat_id, arg_min(x.m, x.p) AS match, arg_min(i.value, x.p) AS value FROM l JOIN i ON i.k = l.x.k GROUP BY stat_id""",
    "family_vote": f"""WITH w AS (
 SELECT stat_id, unnest(regexp_extract_all(lower(vt_label), '[\\p{{L}}\\p{{Nd}}]+')) AS word, 3 AS n FROM sample_stat UNION ALL
 SELECT stat_id, unnest(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{Nd}}]+')), 1 FROM (SELECT stat_id, unnest(vt_names) AS x FROM sample_stat)
), v AS (SELECT stat_id, word, sum(n)::BIGINT AS votes FROM w WHERE length(word) > 1 AND NOT regexp_matches(word, '^[0-9]') AND word NOT IN ({', '.join(f"'{x}'" for x in A.NOISE_WORDS)}) GROUP BY ALL)
SELECT stat_id, word AS family, votes FROM v QUALIFY row_number() OVER (PARTITION BY stat_id ORDER BY votes DESC, word) = 1""",
    "family_recall": """SELECT lower(trim(family)) AS family, count(*) AS total, count_if(coalesce(current_risk, 0) >= 0.5) AS detected, round(count_if(coalesce(current_risk, 0) >= 0.5) / count(*), 6) AS recall,
 arg_min(family_source, stat_id) AS first_source FROM sample_stat WHERE family IS NOT NULL GROUP BY 1""",
    "metadata_coverage": """SELECT input_type, sum(n)::BIGINT AS records, sum(m)::BIGINT AS with_metadata, count(*) AS hash_groups, count_if(f) AS with_family FROM (
 SELECT lower(trim(sha256)) AS k, lower(input_type) AS input_type, count(*) AS n, count(vt_match_type) AS m, bool_or(family IS NOT NULL) AS f FROM sample_stat GROUP BY 1, 2) GROUP BY ROLLUP (input_type)""",
    "mask_runs": """WITH t AS (SELECT r.id AS token, count(*) AS n, sum(round(coalesce(r.severity, 0) * 10000)::BIGINT)::DOUBLE AS total FROM (SELECT unnest(matched_rules) AS r FROM sample_stat) GROUP BY 1),
x AS (SELECT * FROM t, (SELECT unnest([0.0, 0.1, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS level), (SELECT unnest(range(10)) AS run)),
y AS (SELECT *, row_number() OVER (PARTITION BY level, run ORDER BY md5('20260418|' || run || '|' || token)) > greatest(round(count(*) OVER (PARTITION BY level, run) * level), CASE WHEN level > 0 THEN 1 ELSE 0 END) AS kept FROM x),
z AS (SELECT level, run, sum(CASE WHEN kept THEN n ELSE 0 END) / sum(n) AS a, sum(CASE WHEN kept THEN total ELSE 0 END) / sum(total) AS b FROM y GROUP BY ALL)
SELECT level, count(*) AS runs, round(avg(a), 6) AS rows_mean, round(stddev_pop(a), 6) AS rows_std, round(avg(b), 6) AS total_mean, round(stddev_pop(b), 6) AS total_std FROM z GROUP BY level""",
    "set_compare": """WITH a AS (SELECT DISTINCT sample_id, item FROM (SELECT sample_id, unnest(symbols) AS item FROM fas_bytes) WHERE item IS NOT NULL),
b AS (SELECT DISTINCT sample_id, value AS item FROM fas_resources WHERE kind = 'symbol' AND value IS NOT NULL),
c AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, a.item IS NOT NULL AS e, b.item IS NOT NULL AS r FROM a FULL JOIN b ON a.sample_id = b.sample_id AND a.item = b.item)
SELECT sample_id, count_if(e AND r) AS matched, count_if(e AND NOT r) AS missed, count_if(NOT e) AS unexpected,
 round(coalesce(count_if(e AND r) / nullif(count_if(e), 0), 0), 6) AS recall, round(coalesce(count_if(e AND r) / nullif(count_if(r), 0), 0), 6) AS "precision" FROM c GROUP BY sample_id""",
    "set_summary": """WITH a AS (SELECT DISTINCT sample_id, item FROM (SELECT sample_id, unnest(symbols) AS item FROM fas_bytes) WHERE item IS NOT NULL),
b AS (SELECT DISTINCT sample_id, value AS item FROM fas_resources WHERE kind = 'symbol' AND value IS NOT NULL),
c AS (SELECT a.item IS NOT NULL AS e, b.item IS NOT NULL AS r FROM a FULL JOIN b ON a.sample_id = b.sample_id AND a.item = b.item)
SELECT count_if(e AND r) AS matched, count_if(e AND NOT r) AS missed, count_if(NOT e) AS unexpected,
 round(count_if(e AND r) / count_if(e), 6) AS recall, round(count_if(e AND r) / count_if(r), 6) AS "precision" FROM c""",
    "pair_strict": r"""WITH r AS (SELECT DISTINCT path, CASE lower(ext) WHEN '.fas' THEN 'c' WHEN '.lsp' THEN 's' END AS kind,
 regexp_replace(regexp_replace(lower(regexp_extract(path, '[^/\\]*$')), '\.[a-z0-9]+$', ''), '_[0-9]+$', '') AS stem FROM samples),
c AS (SELECT stem, min(path) AS compiled FROM r WHERE kind = 'c' GROUP BY 1), s AS (SELECT stem, min(path) AS source FROM r WHERE kind = 's' GROUP BY 1)
SELECT coalesce(c.stem, s.stem) AS stem, compiled, source FROM c FULL JOIN s ON c.stem = s.stem""",
    "pair_overlap": """WITH a AS (SELECT DISTINCT sample_id AS item, lower(value) AS token FROM fas_resources WHERE kind = 'symbol' AND value IS NOT NULL),
b AS (SELECT DISTINCT sample_id AS item, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_:*<>-]+')) AS token FROM samples WHERE text IS NOT NULL),
s AS (SELECT a.item, b.item AS other, sum(CASE WHEN contains(a.token, ':') THEN 3 ELSE 1 END)::BIGINT AS score FROM a JOIN b ON a.token = b.token AND a.item <> b.item GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, other) AS position, max(score) OVER (PARTITION BY item) AS best FROM s),
u AS (SELECT *, count_if(score = best) OVER (PARTITION BY item) AS ties FROM r)
SELECT item, other, score, position, position = 1 AND ties = 1 AS accepted FROM u WHERE position <= 3""",
    "source_groups": f"WITH {_SOURCES} SELECT source, count(*) AS records FROM so GROUP BY source",
    "source_split": f"""WITH RECURSIVE {_SOURCES}, g AS (SELECT coalesce(source, '#' || stat_id) AS source, count(*) FILTER (label = 'MALICIOUS') AS m, count(*) FILTER (label IS DISTINCT FROM 'MALICIOUS') AS b FROM so GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY m + b DESC, m DESC, md5('20260416|' || source)) AS i FROM g), t AS (SELECT sum(m) * 0.55::DOUBLE AS gm, sum(b) * 0.55::DOUBLE AS gb FROM g),
w(i, dm, db, dev) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, false UNION ALL
 SELECT i, CASE WHEN x THEN dm + m ELSE dm END, CASE WHEN x THEN db + b ELSE db END, x FROM (
  SELECT o.i, w.dm, w.db, o.m, o.b, abs(gm - dm) + abs(gb - db) > abs(gm - (dm + m)) + abs(gb - (db + b)) AS x FROM w JOIN o ON o.i = w.i + 1, t))
SELECT stat_id, o.source, CASE WHEN dev THEN 'dev' ELSE 'test' END AS split FROM so JOIN o ON o.source = coalesce(so.source, '#' || stat_id) JOIN w ON w.i = o.i""",
}


def whole_counts(sql: str) -> str:
    """``count_if(x)`` as a count of type BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(nullif({sql[at + len('count_if(') : end - 1]}, false)){sql[end:]}"
    return sql


SQL = {k: whole_counts(v) for k, v in SQL.items()}
