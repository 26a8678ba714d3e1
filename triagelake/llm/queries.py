"""Named queries of the training-data problems, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import annotators, grouped_split, mixture, mojibake, near_duplicates, percentiles, source_syntax, split_overlap, tokenise, truncation
from triagelake.session import staged, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotators.misnamed(table(spark, sf_dir, "engine_labels"), table(spark, sf_dir, "sample_stat"))


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotators.engine_consensus(table(spark, sf_dir, "engine_labels")).result


def p1_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotators.engine_consensus(table(spark, sf_dir, "engine_labels")).annotators


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "engine_labels")
    items, _ = annotators.gather(
        labels, annotators.key(F.col("sha256")), annotators.key(F.col("engine")), annotators.family_of(F.col("result")), F.struct("scanned_at", "label_id")
    )
    return annotators.alpha(items)


def _near(spark: SparkSession, sf_dir: str):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "baseline_sample"), "row_id", ["text", "semantic"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.pairs(*_near(spark, sf_dir))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(*_near(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.found_pairs(table(spark, sf_dir, "baseline_sample"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.report(table(spark, sf_dir, "baseline_sample"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.classes(*split_overlap.split_overlap(table(spark, sf_dir, "baseline_sample")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_syntax.found(table(spark, sf_dir, "samples"))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_syntax.judged(table(spark, sf_dir, "samples"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_syntax.rates(table(spark, sf_dir, "samples"), table(spark, sf_dir, "eval_rows"))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(percentiles.eval_runs(table(spark, sf_dir, "eval_rows")))
    return percentiles.percentiles(stored, names=("input_type", "metric"))


def p5_day_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    partials = percentiles.day_partials(table(spark, sf_dir, "eval_rows"))
    return partials.select("day", F.col("grp").alias("input_type"), "metric", "n", "vals", "wts")


def p5_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.from_partials(staged(percentiles.day_partials(table(spark, sf_dir, "eval_rows"))), names=("input_type", "metric"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.found(table(spark, sf_dir, "sample_stat"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.stat_splits(table(spark, sf_dir, "sample_stat"), table(spark, sf_dir, "split_targets"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.split_report(p6_splits(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(table(spark, sf_dir, "fas_resources"), table(spark, sf_dir, "fas_bytes"))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(table(spark, sf_dir, "fas_resources"), table(spark, sf_dir, "fas_bytes"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p8_halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids with leaves so small that many words are halved and joined."""
    return tokenise.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"], leaf=8, piece=64)


def _mixture(spark: SparkSession, sf_dir: str):
    counts = mixture.staged_counts(table(spark, sf_dir, "documents"))
    return counts, mixture.plan(counts, table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.draw(*_mixture(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(*_mixture(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.scores(table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_consensus": p1_consensus,
        "p1_engines": p1_engines,
        "p1_agreement": p1_agreement,
        "p2_found": p2_found,
        "p2_classes": p2_classes,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p3_classes": p3_classes,
        "p4_found": p4_found,
        "p4_files": p4_files,
        "p4_rates": p4_rates,
        "p5_percentiles": p5_percentiles,
        "p5_day_partials": p5_day_partials,
        "p5_from_days": p5_from_days,
        "p6_found": p6_found,
        "p6_splits": p6_splits,
        "p6_shares": p6_shares,
        "p7_found": p7_found,
        "p7_restored": p7_restored,
        "p8_ids": p8_ids,
        "p8_halved": p8_halved,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_scores": p10_scores,
        "p10_rates": p10_rates,
    }


_RUNS = r"""
runs AS (
    SELECT id, side, f, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g
    FROM (SELECT id, side, f, regexp_extract_all(lower(v), '[\p{L}\p{N}]+') AS w FROM vals)
    WHERE len(w) >= 20
), sizes AS (SELECT id, f, count(*) AS n FROM runs GROUP BY id, f)
"""

_P2 = (
    """WITH vals AS (
    SELECT row_id AS id, 0 AS side, 0 AS f, text AS v FROM baseline_sample WHERE text IS NOT NULL
    UNION ALL SELECT row_id, 0, 1, semantic FROM baseline_sample WHERE semantic IS NOT NULL
), """
    + _RUNS
    + """, shared AS (
    SELECT a.f, a.id AS x, b.id AS y, count(*) AS o FROM runs a JOIN runs b ON a.f = b.f AND a.g = b.g AND a.id < b.id GROUP BY ALL
)
SELECT DISTINCT x AS row_id_a, y AS row_id_b FROM shared s
JOIN sizes p ON p.id = s.x AND p.f = s.f JOIN sizes q ON q.id = s.y AND q.f = s.f
WHERE o >= 0.6 * (p.n + q.n - o) - 1e-9"""
)

_P3 = (
    """WITH vals AS (
    SELECT row_id AS id, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS side, 0 AS f, text AS v
    FROM baseline_sample WHERE text IS NOT NULL AND split IN ('train', 'dev', 'test')
), """
    + _RUNS
    + """, shared AS (
    SELECT a.id AS x, b.id AS y, count(*) AS o FROM runs a JOIN runs b ON a.g = b.g WHERE a.side = 0 AND b.side = 1 GROUP BY ALL
), found AS (
    SELECT x, y FROM shared s JOIN sizes q ON q.id = s.y WHERE o >= 0.75 * q.n - 1e-9
    UNION
    SELECT a.row_id, b.row_id FROM baseline_sample a JOIN baseline_sample b
    ON lower(replace(a.sample, '\\', '/')) = lower(replace(b.sample, '\\', '/')) WHERE a.split = 'train' AND b.split IN ('dev', 'test')
)
SELECT DISTINCT least(x, y) AS row_id_a, greatest(x, y) AS row_id_b FROM found"""
).replace("'\\\\'", "'\\'")


_CLASSES = """
cls AS (SELECT id, side, f, md5(string_agg(g, '|' ORDER BY g)) AS c FROM runs GROUP BY ALL),
grp AS (SELECT side, f, c, min(id) AS class_id, count(*) AS class_rows FROM cls GROUP BY ALL),
rep AS (SELECT r.* FROM runs r JOIN grp ON class_id = r.id AND grp.f = r.f AND grp.side = r.side)"""

_P2_CLASSES = (
    """WITH vals AS (
    SELECT row_id AS id, 0 AS side, 0 AS f, text AS v FROM baseline_sample WHERE text IS NOT NULL
    UNION ALL SELECT row_id, 0, 1, semantic FROM baseline_sample WHERE semantic IS NOT NULL
), """
    + _RUNS
    + ","
    + _CLASSES
    + """, shared AS (
    SELECT a.f, a.id AS x, b.id AS y, count(*) AS o FROM rep a JOIN rep b ON a.f = b.f AND a.g = b.g AND a.id < b.id GROUP BY ALL
), links AS (
    SELECT s.f, x, y FROM shared s JOIN sizes p ON p.id = s.x AND p.f = s.f JOIN sizes q ON q.id = s.y AND q.f = s.f WHERE o >= 0.6 * (p.n + q.n - o) - 1e-9
), deg AS (SELECT f, e AS class_id, count(*) AS links FROM (SELECT f, unnest([x, y]) AS e FROM links) GROUP BY ALL)
SELECT cls.id AS row_id, cls.f AS field, grp.class_id, class_rows, coalesce(links, 0) AS links FROM cls JOIN grp USING (side, f, c) LEFT JOIN deg ON deg.f = cls.f AND deg.class_id = grp.class_id"""
)

_P3_LINKS = (
    """WITH vals AS (
    SELECT row_id AS id, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS side, 0 AS f, text AS v
    FROM baseline_sample WHERE text IS NOT NULL AND split IN ('train', 'dev', 'test')
), """
    + _RUNS
    + ","
    + _CLASSES
    + """, shared AS (
    SELECT a.id AS x, b.id AS y, count(*) AS o FROM rep a JOIN rep b ON a.g = b.g WHERE a.side = 0 AND b.side = 1 GROUP BY ALL
), links AS (SELECT x, y, o / n AS held FROM shared JOIN sizes q ON q.id = y WHERE o >= 0.75 * n - 1e-9)"""
)

_P3_CLASSES = (
    _P3_LINKS
    + """, deg AS (SELECT side, class_id, count(*) AS links FROM (SELECT 0 AS side, x AS class_id FROM links UNION ALL SELECT 1, y FROM links) GROUP BY ALL)
SELECT cls.id AS row_id, CASE WHEN cls.side = 0 THEN 'train' ELSE 'evaluation' END AS side, grp.class_id, class_rows, coalesce(links, 0) AS links
FROM cls JOIN grp USING (side, f, c) LEFT JOIN deg ON deg.side = cls.side AND deg.class_id = grp.class_id"""
)

_P3_REPORT = (
    _P3_LINKS
    + r""", best AS (SELECT y, max(held) AS held FROM links GROUP BY y),
hit AS (SELECT id, held FROM cls JOIN grp USING (side, f, c) JOIN best ON y = class_id WHERE cls.side = 1),
keys AS (SELECT DISTINCT lower(replace(sample, '\', '/')) AS k FROM baseline_sample WHERE split = 'train' AND sample IS NOT NULL),
ev AS (SELECT row_id, split, lower(replace(sample, '\', '/')) AS k FROM baseline_sample WHERE split IN ('dev', 'test'))
SELECT split, string_split(k, '/')[1] AS repository, count(*) AS records, count(held) AS text_overlaps, count(keys.k) AS sample_overlaps, count(CASE WHEN held IS NOT NULL OR keys.k IS NOT NULL THEN 1 END) AS overlaps,
 round(count(CASE WHEN held IS NOT NULL OR keys.k IS NOT NULL THEN 1 END) / count(*), 6) AS overlap_rate, round(avg(held), 6) AS mean_overlap
FROM (SELECT ev.*, hit.held FROM ev LEFT JOIN hit ON hit.id = ev.row_id) LEFT JOIN keys USING (k) GROUP BY 1, 2"""
).replace("'\\\\'", "'\\'")


_P5 = """WITH once AS (
    SELECT eval_id, min_by(lower(trim(input_type)), ingest_ts) AS input_type, min_by(total_ms, ingest_ts) AS total_ms,
           min_by(parse_ms, ingest_ts) AS parse_ms, min_by(ir_ms, ingest_ts) AS ir_ms
    FROM (SELECT eval_id, ingest_ts, input_type, coalesce(total_ms, -1) AS total_ms, coalesce(parse_ms, -1) AS parse_ms, coalesce(ir_ms, -1) AS ir_ms FROM eval_rows)
    GROUP BY eval_id
), vals AS (
    SELECT input_type, 'total_ms' AS metric, total_ms AS v FROM once UNION ALL
    SELECT input_type, 'parse_ms', parse_ms FROM once UNION ALL
    SELECT input_type, 'ir_ms', ir_ms FROM once
), ranked AS (
    SELECT input_type, metric, v, row_number() OVER (PARTITION BY input_type, metric ORDER BY v) AS r, count(*) OVER (PARTITION BY input_type, metric) AS n
    FROM vals WHERE v > 0 AND isfinite(v) AND input_type <> ''
)
SELECT input_type, metric, q, n, v AS value FROM ranked
JOIN (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]::DOUBLE[]) AS q) ON r = greatest(ceil(q * n - 1e-9)::BIGINT, 1)"""


_P6 = """WITH RECURSIVE rows_ AS (
    SELECT stat_id AS id, nullif(lower(trim(family)), '') AS c, nullif(lower(trim(sha256)), '') AS f FROM sample_stat
), fams AS (SELECT c, min(id) AS cid FROM rows_ WHERE c IS NOT NULL GROUP BY c),
shas AS (SELECT f, min(cid) AS least, min(id) AS fmin FROM rows_ LEFT JOIN fams USING (c) WHERE f IS NOT NULL GROUP BY f),
edges AS (SELECT DISTINCT fa.cid AS u, s.least AS v FROM rows_ r JOIN fams fa USING (c) JOIN shas s USING (f) WHERE fa.cid <> s.least),
sym AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(n, m) AS (SELECT u, u FROM sym UNION SELECT r.n, s.v FROM reach r JOIN sym s ON s.u = r.m),
roots AS (SELECT n, min(m) AS root FROM reach GROUP BY n),
marked AS (
    SELECT r.id, coalesce(rc.root, fa.cid, rs.root, s.least, s.fmin, r.id) AS root FROM rows_ r
    LEFT JOIN fams fa ON fa.c = r.c LEFT JOIN roots rc ON rc.n = fa.cid
    LEFT JOIN shas s ON s.f = r.f LEFT JOIN roots rs ON rs.n = s.least
)
SELECT id AS stat_id, group_id FROM (SELECT id, min(id) OVER (PARTITION BY root) AS group_id, count(*) OVER (PARTITION BY root) AS n FROM marked) WHERE n > 1"""


_P1 = f"""WITH n AS (
    SELECT nullif(lower(trim(sha256)), '') AS item, nullif(lower(trim(engine)), '') AS who, scanned_at, label_id,
           coalesce(list_filter(regexp_extract_all(lower(result), '\\p{{L}}+'), lambda w: length(w) >= 4 AND w NOT IN ({", ".join(f"'{w}'" for w in annotators.GENERIC_WORDS)}))[1],
            list_filter(regexp_extract_all(lower(result), '\\p{{L}}+'), lambda w: CASE WHEN regexp_matches(w, '^[a-z]+$') THEN length(w) = 3 ELSE length(w) BETWEEN 2 AND 3 END AND w NOT IN ({", ".join(f"'{w}'" for w in annotators.GENERIC_SHORT_WORDS)}))[1]) AS label
    FROM engine_labels
), v AS (
    SELECT item, who, arg_max(label, struct_pack(a := scanned_at, b := label_id)) AS label FROM n
    WHERE item IS NOT NULL AND who IS NOT NULL AND label IS NOT NULL GROUP BY ALL
), c AS (SELECT item, label, count(*) AS n FROM v GROUP BY ALL),
i AS (SELECT item, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY item HAVING sum(n) > 1),
o AS (SELECT count(*) AS items, sum(m)::BIGINT AS ratings, sum((m * m - sq) / (m - 1)) AS o FROM i),
t AS (SELECT sum(n * n)::DOUBLE AS sq FROM (SELECT label, sum(n)::DOUBLE AS n FROM c SEMI JOIN i USING (item) GROUP BY label))
SELECT items, ratings, round(o / ratings, 6) AS observed, round((ratings::DOUBLE * ratings - sq) / (ratings::DOUBLE * (ratings - 1)), 6) AS expected,
       round(1 - o / ratings / ((ratings::DOUBLE * ratings - sq) / (ratings::DOUBLE * (ratings - 1))), 6) AS alpha FROM o, t WHERE ratings > 1"""


def oracle_sql() -> dict[str, str]:
    return {"p1_agreement": _P1, "p2_found": _P2, "p2_classes": _P2_CLASSES, "p3_found": _P3, "p3_classes": _P3_CLASSES, "p3_report": _P3_REPORT, "p5_percentiles": _P5, "p6_found": _P6}
