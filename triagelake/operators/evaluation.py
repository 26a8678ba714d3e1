"""Batch and research analytics over evaluation rows and evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators.scoring import Parameters, floor_of, multiplier_of, risk
from triagelake.session import hot_keys, join_unique, staged

STAGES = ("read_ms", "frontend_ms", "parse_ms", "ir_ms", "formal_ms", "detection_ms", "encoding_ms", "total_ms")
FAILED = ("TIMEOUT", "ERROR")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def is_benign(sample: Column) -> Column:
    """Ground truth from the prefix of the file's name."""
    return basename(sample).startswith("white_")


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def delivered_once(evals: DataFrame, *columns: str) -> DataFrame:
    """One row per evaluation: the first delivery, projected first so that
    only the columns in use are shuffled."""
    return evals.select("eval_id", "ingest_ts", *columns).groupBy("eval_id").agg(F.min_by(F.struct(*columns), "ingest_ts").alias("r")).select("eval_id", "r.*")


def confusion(rows: DataFrame, actual: Column, predicted: Column, *by: Column) -> DataFrame:
    """Confusion counts and rates; divisions by zero give 0."""
    agg = rows.groupBy(*by).agg(
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(~actual & ~predicted).alias("tn"), F.count_if(actual & ~predicted).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return agg.select(
        "*", F.round(safe_divide(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("tpr"),
        F.round(safe_divide(fp, fp + tn), 6).alias("fpr"), F.round(safe_divide(fn, tp + fn), 6).alias("fnr"), F.round(safe_divide(2 * p * r, p + r), 6).alias("f1"),
    )


def eval_confusion(evals: DataFrame, by_type: bool = False) -> DataFrame:
    """Verdicts against ground truth; failed evaluations take no part."""
    rows = delivered_once(evals, "sample", "verdict", "input_type").where(~F.col("verdict").isin(*FAILED))
    rows = rows.select(is_benign(F.col("sample")).alias("benign"), "verdict", F.lower("input_type").alias("input_type"))
    if not by_type:
        return confusion(rows, ~F.col("benign"), F.col("verdict") == "MALICIOUS")
    cube = rows.rollup("input_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if((F.col("verdict") == "MALICIOUS") & ~F.col("benign")).alias("tp"), F.count_if((F.col("verdict") == "MALICIOUS") & F.col("benign")).alias("fp")
    )
    return cube


def timing(evals: DataFrame) -> DataFrame:
    """Mean, exact median and maximum of each stage's measured times."""
    rows = delivered_once(evals, "verdict", *STAGES).where(~F.col("verdict").isin(*FAILED))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("ms")) for s in STAGES])).alias("x")).select("x.*")
    long = staged(long.where(F.col("ms").isNotNull() & ~F.isnan("ms") & (F.col("ms") >= 0) & (F.col("ms") < 1e300)))
    sums = long.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 3).alias("avg_ms"), F.round(F.max("ms"), 6).alias("max_ms"))
    middle = long.sparkSession.createDataFrame(medians(long, "stage", "ms"), "stage string, median_ms double")
    return sums.join(F.broadcast(middle), "stage").select("stage", "n", "avg_ms", F.round("median_ms", 6).alias("median_ms"), "max_ms")


# values of a group that may be sorted in one buffer
SORTED = 100_000
MAX_GROUPS = 1_000


def medians(rows: DataFrame, group: str, value: str, limit: int = SORTED) -> list[tuple]:
    """(group, median) of few groups of any size, exact.

    The range that holds the middle is narrowed by approximate percentiles
    and counted, until few enough values are left in it to sort them; no
    buffer holds more than ``limit`` different values of a group.
    """
    spark = rows.sparkSession
    g, v = F.col(group), F.col(value)
    total = {r[0]: r[1] for r in rows.groupBy(g).count().limit(MAX_GROUPS + 1).collect()}
    if len(total) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    # [lo, hi] holds both middle values; below: how many values are less than lo
    open_ = {k: (float("-inf"), float("inf"), 0, n) for k, n in total.items()}
    out = {}
    while open_:
        table = spark.createDataFrame([(k, *x[:2], x[3]) for k, x in open_.items()], "_g string, _lo double, _hi double, _n bigint")
        inside = rows.select(g.cast("string").alias("_g"), v.alias("_v")).join(F.broadcast(table), "_g").where("_v >= _lo and _v <= _hi")
        below = {k: x[2] for k, x in open_.items()}
        at = lambda k: ((total[k] - 1) // 2 - below[k], total[k] // 2 - below[k])
        picks = spark.createDataFrame([(k, *at(k)) for k in open_], "_g string, a bigint, b bigint")
        # equal values are one row; a window holds at most ``limit`` of them
        small = inside.where(F.col("_n") <= limit).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        holds = lambda x: (F.col("before") <= F.col(x)) & (F.col(x) < F.col("before") + F.col("n"))
        ends = small.withColumn("before", before).join(F.broadcast(picks), "_g").groupBy("_g").agg(
            F.max(F.when(holds("a"), F.col("_v"))).alias("a"), F.max(F.when(holds("b"), F.col("_v"))).alias("b")
        )
        for r in ends.collect():
            out[r[0]] = (r.a + r.b) / 2
            del open_[r[0]]
        if not open_:
            break
        shares = [(k, max((at(k)[0] + 1) / x[3] - 0.002, 0.0), min((at(k)[1] + 1) / x[3] + 0.002, 1.0)) for k, x in open_.items()]
        near = []
        for k, low, high in shares:  # a few groups; each is one aggregate of the same pass
            near += [F.percentile_approx(F.when(F.col("_g") == k, F.col("_v")), [low, high], 10_000)]
        bounds = dict(zip([k for k, *_ in shares], inside.agg(*near).first()))
        table = spark.createDataFrame([(k, float(b[0]), float(b[1])) for k, b in bounds.items()], "_g string, _a double, _b double")
        counted = inside.join(F.broadcast(table), "_g").groupBy("_g").agg(
            F.count_if(F.col("_v") < F.col("_a")).alias("less"), F.count_if(F.col("_v").between(F.col("_a"), F.col("_b"))).alias("n"), F.first("_a").alias("a"), F.first("_b").alias("b")
        )
        for r in counted.collect():
            k, (lo, hi, was, n) = r[0], open_[r[0]]
            first, last = at(k)
            if r.less <= first and last < r.less + r.n and (r.n < n or r.a == r.b):
                if r.a == r.b:
                    out[k] = r.a
                    del open_[k]
                else:
                    open_[k] = (r.a, r.b, was + r.less, r.n)
            else:  # nothing got less, as few values are repeated: sort those
                open_[k] = (lo, hi, was, min(n, limit))
    return [(k, float(x)) for k, x in sorted(out.items())]


def report(evals: DataFrame, top: int = 100) -> DataFrame:
    """Batch report: failures last, riskiest first, then by name; ``top`` is
    the length of the report."""
    rows = delivered_once(evals, "sample", "verdict", "risk")
    failed = F.col("verdict").isin(*FAILED)
    order = [failed.asc(), F.coalesce("risk", F.lit(0.0)).desc(), F.col("sample").asc(), F.col("eval_id").asc()]
    first = rows.orderBy(*order).limit(top)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("position", "eval_id", "sample", "verdict", "risk")


# ----------------------------------------------------------- replay and grid


def evidence(stats: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Evidence columns of the experiment table, nulls as 0, and the highest
    floor among the rules a sample matched."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    floor = F.coalesce(F.array_max(F.transform("matched_rules", lambda r: floor_of(r["id"], p))), F.lit(0.0))
    return stats.select(
        "stat_id", (F.col("label") == "MALICIOUS").alias("malicious"), z("rule_evidence"), z("attack_evidence"), z("feature_evidence"), z("formal_evidence"), z("context_score"), floor.alias("floor")
    )


def _risk(p: Parameters) -> Column:
    return risk(p, *[F.col(c) for c in ("rule_evidence", "attack_evidence", "feature_evidence", "formal_evidence", "context_score")], F.col("floor") * F.lit(p.floor_factor))


def replay(stats: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Scores from cached evidence, without analysing again."""
    r = _risk(p)
    return evidence(stats, p).select("stat_id", F.round(r, 6).alias("risk"), F.when(r >= p.threshold, "MALICIOUS").otherwise("BENIGN").alias("verdict"))


# fixed values: the calibration grid
RULE_WEIGHTS = (0.25, 0.30, 0.35, 0.40)
ATTACK_WEIGHTS = (0.20, 0.25, 0.30)
FEATURE_WEIGHTS = (0.20, 0.25, 0.30)
SLOPES = (3.0, 4.0, 5.0, 6.0)
THRESHOLDS = (0.45, 0.50, 0.55, 0.60, 0.65)
FLOOR_FACTORS = (0.9, 1.0, 1.1)


def grid() -> list[tuple]:
    """(ordinal, rule, attack, feature, formal, slope, threshold, factor); the
    formal weight is what the others leave and stays within its bounds."""
    out = []
    for r in RULE_WEIGHTS:
        for a in ATTACK_WEIGHTS:
            for f in FEATURE_WEIGHTS:
                rest = 1.0 - r - a - f
                if 0.05 <= rest <= 0.30:
                    out += [(r, a, f, rest, k, t, x) for k in SLOPES for t in THRESHOLDS for x in FLOOR_FACTORS]
    return [(i, *c) for i, c in enumerate(out)]


def grid_counts(stats: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Confusion counts of every candidate of the grid.

    The grid is a constant of fixed size; each weight triple is a row of a
    literal array, the inner candidates are evaluated side by side, and the
    counts are combined before anything is shuffled.
    """
    e = evidence(stats, p)
    triples: dict[tuple, list] = {}
    for i, r, a, f, rest, k, t, x in grid():
        triples.setdefault((r, a, f, rest), []).append((i, k, t, x))
    names = ("w_rule", "w_attack", "w_feature", "w_formal")
    literal = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, w)], F.lit(c[0][0]).alias("base")) for w, c in triples.items()])
    inner = next(iter(triples.values()))
    settings = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("slope"), F.lit(t).alias("threshold"), F.lit(x).alias("factor")) for j, (_, k, t, x) in enumerate(inner)])
    w = e.select("*", F.explode(literal).alias("w")).select("*", "w.*")
    c = F.col
    rest = c("w_rule") + c("w_attack") + c("w_feature")
    none = c("formal_evidence") <= 0
    scale = F.when(none, (rest + c("w_formal")) / rest).otherwise(1.0)
    combined = scale * c("w_rule") * c("rule_evidence") + scale * c("w_attack") * c("attack_evidence") + scale * c("w_feature") * c("feature_evidence")
    combined = combined + F.when(none, 0.0).otherwise(c("w_formal")) * c("formal_evidence")
    # equal evidence meets equal candidates: count distinct vectors once
    cells = w.select("base", "malicious", F.round(combined, 12).alias("x"), (c("context_score") > 0.7).alias("boost"), "floor")
    cells = cells.groupBy("base", "malicious", "x", "boost", "floor").agg(F.count(F.lit(1)).alias("n"))
    each = cells.select("*", F.explode(settings).alias("s")).select("base", "malicious", "x", "boost", "floor", "n", "s.*")
    base = F.lit(1.0) / (F.lit(1.0) + F.exp(-c("slope") * (c("x") - 0.5)))
    base = F.when(c("boost"), F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    hit = F.round(F.greatest(base, c("floor") * c("factor")), 9) >= c("threshold")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0))
    out = each.withColumn("hit", hit).groupBy((c("base") + c("j")).alias("candidate")).agg(
        n(c("malicious") & c("hit")).alias("tp"), n(~c("malicious") & c("hit")).alias("fp"), n(~c("malicious") & ~c("hit")).alias("tn"), n(c("malicious") & ~c("hit")).alias("fn")
    )
    return out


def grid_search(stats: DataFrame, max_fpr: float = 0.03) -> DataFrame:
    """All candidates with their counts and rank: within the false-positive
    bound, F1, accuracy, fewer false positives; ties go to the parameters in
    use, then to grid order."""
    g = stats.sparkSession.createDataFrame(grid(), "candidate int, w_rule double, w_attack double, w_feature double, w_formal double, slope double, threshold double, factor double")
    m = grid_counts(stats)
    c = F.col
    p, r = safe_divide(c("tp"), c("tp") + c("fp")), safe_divide(c("tp"), c("tp") + c("fn"))
    m = m.withColumns({
        "f1": F.round(safe_divide(2 * p * r, p + r), 6),
        "accuracy": F.round(safe_divide(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")), 6),
        "fpr": F.round(safe_divide(c("fp"), c("fp") + c("tn")), 6),
    })
    p = Parameters()
    used = (c("w_rule") == p.rule) & (c("w_attack") == p.attack) & (c("w_feature") == p.feature) & (c("slope") == p.slope) & (c("threshold") == p.threshold) & (c("factor") == p.floor_factor)
    order = Window.orderBy((c("fpr") <= max_fpr).desc(), c("f1").desc(), c("accuracy").desc(), c("fpr").asc(), used.desc(), c("candidate").asc())
    return g.join(F.broadcast(m), "candidate").withColumn("position", F.row_number().over(order).cast("bigint")).withColumn("candidate", c("candidate").cast("bigint"))


def ablations(stats: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Counts of five parameter sets, each with a part of the score left out."""
    both, three = p.rule + p.attack, p.rule + p.attack + p.feature
    variants = {
        "Feature-Only": Parameters(0.0, 0.0, 1.0, 0.0, p.slope, p.threshold, floor_factor=0.0),
        "Rule+ATT&CK Only": Parameters(p.rule / both, p.attack / both, 0.0, 0.0, p.slope, p.threshold, floor_factor=0.0),
        "No-Floor": Parameters(p.rule, p.attack, p.feature, p.formal, p.slope, p.threshold, floor_factor=0.0),
        "No-Formal": Parameters(p.rule / three, p.attack / three, p.feature / three, 0.0, p.slope, p.threshold),
        "Full": p,
    }
    e = evidence(stats, p)
    marked = e.select("malicious", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), (F.round(_risk(q), 9) >= q.threshold).alias("hit")) for n, q in variants.items()])).alias("v"))
    return confusion(marked.select("malicious", "v.*"), F.col("malicious"), F.col("hit"), F.col("variant"))


# fixed values: the rules whose multipliers are tuned, and the values tried
TUNED_RULES = ("COM_DROPPER_001", "FINDCOPY_001", "NETWORK_001", "NET_DROPPER_001", "NET_STUB_001", "REC_FAS_PROP_001", "REGISTRY_001")
MULTIPLIERS = (0.4, 0.6, 0.8, 1.0, 1.2, 1.4)


def coordinate_descent(stats: DataFrame, p: Parameters = Parameters(), max_fpr: float = 0.03, passes: int = 3) -> DataFrame:
    """Multipliers of single rules, tuned one at a time; the values of one
    rule are compared in one aggregation."""
    best = dict.fromkeys(TUNED_RULES, 1.0)
    rows = evidence(stats, p).join(stats.select("stat_id", "matched_rules"), "stat_id")

    def rule_mean(m: dict) -> Column:
        q = Parameters(multipliers=m)
        total = F.aggregate("matched_rules", F.lit(0.0), lambda a, r: a + F.coalesce(r["severity"], F.lit(0.0)) * multiplier_of(r["id"], q))
        n = F.size("matched_rules")
        return F.when(n > 0, total / n).otherwise(0.0)

    def key(tp, fp, tn, fn):
        prec, rec = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        fpr = fp / (fp + tn) if fp + tn else 0.0
        return (fpr <= max_fpr, f1, (tp + tn) / max(tp + fp + tn + fn, 1), -fpr)

    incumbent = None
    for _ in range(passes):
        moved = False
        for rule in TUNED_RULES:
            aggs = []
            for j, x in enumerate(MULTIPLIERS):
                hit = risk(p, rule_mean({**best, rule: x}), *[F.col(c) for c in ("attack_evidence", "feature_evidence", "formal_evidence", "context_score", "floor")]) >= p.threshold
                m = F.col("malicious")
                aggs += [F.count_if(m & hit).alias(f"tp{j}"), F.count_if(~m & hit).alias(f"fp{j}"), F.count_if(~m & ~hit).alias(f"tn{j}"), F.count_if(m & ~hit).alias(f"fn{j}")]
            r = rows.agg(*aggs).first()
            for j, x in enumerate(MULTIPLIERS):
                k = key(*[r[f"{n}{j}"] for n in ("tp", "fp", "tn", "fn")])
                if incumbent is None or k > incumbent:
                    incumbent, moved = k, moved or best[rule] != x
                    best[rule] = x
        if not moved:
            break
    return stats.sparkSession.createDataFrame(sorted(best.items()), "rule_id string, multiplier double")


# --------------------------------------------------------------------- splits


def ranked_below(df: DataFrame, by: list[str], digest: str, share: float, least: int = 1) -> DataFrame:
    """Rows whose rank by ``digest`` (hex) within ``by`` is at most
    ``round(share * n)``, kept within ``[least, n - 1]``; column ``chosen``."""
    n = F.col("_total")
    return ranked_first(df, by, digest, F.greatest(F.least(F.round(n * F.lit(share)), n - 1), F.least(F.lit(least), n)))


def ranked_first(df: DataFrame, by: list[str], digest: str, k: Column) -> DataFrame:
    """Column ``chosen``: is the rank by ``digest`` (hex) within ``by`` at most
    ``k``, a column of the group's own columns and of its size ``_total``.

    Ranks come from a histogram over the leading digits: only the bucket that
    the limit falls into is ranked row by row, so no group is sorted whole.
    """
    rows = df.withColumn("_b", F.substring(digest, 1, 4))
    extra = [c for c in df.columns if c not in (*by, digest) and c.startswith("_")]
    hist = rows.groupBy(*by, *extra, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hist = hist.withColumn("_total", F.sum("_n").over(w)).withColumn("_limit", k.cast("bigint"))
    joined = rows.drop(*extra).join(hist.select(*by, "_b", "_n", "_before", "_limit"), [*by, "_b"])
    edge = (F.col("_before") < F.col("_limit")) & (F.col("_before") + F.col("_n") > F.col("_limit"))
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(digest))
    ranked = joined.where(edge).withColumn("chosen", F.col("_before") + inner <= F.col("_limit"))
    plain = joined.where(~edge).withColumn("chosen", F.col("_before") + F.col("_n") <= F.col("_limit"))
    return ranked.unionByName(plain).drop("_b", "_n", "_before", "_limit")


def stratified_split(stats: DataFrame, share: float = 0.55, seed: int = 20260416) -> DataFrame:
    """``share`` of each label to dev, chosen by digest, the rest to test."""
    rows = stats.select("stat_id", "label", F.md5(F.concat(F.lit(f"{seed}|"), F.col("stat_id").cast("string"))).alias("h"))
    return ranked_below(rows, ["label"], "h", share).select("stat_id", "label", F.when(F.col("chosen"), "dev").otherwise("test").alias("split"))


def family_split(stats: DataFrame, share: float = 0.55, seed: int = 20260416) -> DataFrame:
    """Whole families to dev, in digest order, until the target is passed."""
    fam = F.coalesce(F.lower(F.trim("family")), F.concat(F.lit("#"), F.col("stat_id").cast("string")))
    rows = stats.select("stat_id", fam.alias("family"))
    groups = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("family"))))
    groups = groups.withColumn("b", F.substring("h", 1, 3))
    # prefix sums in two levels: over the buckets, then inside each bucket
    buckets = groups.groupBy("b").agg(F.sum("n").alias("bn"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = rows.count()
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = groups.withColumn("inside", inside).join(buckets.select("b", "before"), "b")
    placed = placed.select("family", F.when(F.col("before") + F.col("inside") < total * share, "dev").otherwise("test").alias("split"))
    return join_unique(rows, placed, "family", "inner", hot_keys(rows, "family")).select("stat_id", "split")


# fixed values: name parts that tell no source
GENERIC_PARTS = ("vt", "vtmsistake", "sample", "file", "plugin", "lisp", "lisps", "tool", "tools", "program", "programs")


def source_key(sample: Column) -> Column:
    """Source group of a file, from the first telling parts of its name."""
    base = F.regexp_replace(F.lower(basename(sample)), r"\.[^.]*$", "")
    for ending in (".acad", ".acaddoc", ".mnl", ".dcl"):
        base = F.regexp_replace(base, ending.replace(".", r"\.") + "$", "")
    base = F.trim(F.regexp_replace(base, "^white_", ""))
    parts = F.filter(F.split(base, r"[_\- .()\[\]{}+]"), lambda x: (F.trim(x) != "") & (x != "white"))
    dull = lambda x: x.isin(*GENERIC_PARTS)
    hashed = lambda x: x.rlike("^[0-9a-f]{16,}$")
    told = F.filter(parts, lambda x: ~dull(x))
    # generic parts before the first telling one are skipped, later ones end the key
    first = F.get(told, 0)
    k = F.array_position(parts, first).cast("int")
    second, third = F.get(parts, k), F.get(parts, k + 1)
    plain = lambda x: F.coalesce(~hashed(x) & ~dull(x), F.lit(False))
    keyed = (
        F.when(hashed(first), F.when(plain(second), F.when(plain(third), F.concat(F.lit("src:"), second, F.lit("_"), third)).otherwise(F.concat(F.lit("src:"), second))).otherwise(F.concat(F.lit("hash:"), F.substring(first, 1, 16))))
        .when(plain(second), F.concat(F.lit("src:"), first, F.lit("_"), second))
        .otherwise(F.concat(F.lit("src:"), first))
    )
    return F.coalesce(keyed, F.concat(F.lit("sample:"), base))


MAX_UNITS = 1_000_000


def source_split(stats: DataFrame, share: float = 0.55, seed: int = 20260416) -> DataFrame:
    """Whole sources to dev or test, greedily, largest first (of those the
    ones with more malicious records, then by digest), balancing the targets
    of the two labels.

    Sources with equal counts are one unit of the choice: of each so many go
    to dev, which the driver finds by halving; units are far fewer than
    sources (more than ``MAX_UNITS`` are refused).
    """
    source = F.coalesce(source_key(F.col("sample")), F.concat(F.lit("#"), F.col("stat_id").cast("string")))
    rows = stats.select("stat_id", source.alias("source"), (F.col("label") == "MALICIOUS").cast("int").alias("m"))
    groups = rows.groupBy("source").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), (F.count(F.lit(1)) - F.coalesce(F.sum("m"), F.lit(0))).alias("b"))
    groups = staged(groups.withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("source")))))
    units = [tuple(r) for r in groups.groupBy("m", "b").agg(F.count(F.lit(1)).alias("k")).limit(MAX_UNITS + 1).collect()]
    if len(units) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} kinds of sources")
    goal = (sum(m * k for m, _, k in units) * share, sum(b * k for _, b, k in units) * share)
    far = lambda m, b: abs(goal[0] - m) + abs(goal[1] - b)
    dm = db = 0
    chosen = []
    for m, b, k in sorted(units, key=lambda u: (-u[0] - u[1], -u[0])):
        # each further source of a unit gains no more than the one before
        low, high = 0, k
        while low < high:
            mid = (low + high) // 2
            if far(dm + mid * m, db + mid * b) > far(dm + (mid + 1) * m, db + (mid + 1) * b):
                low = mid + 1
            else:
                high = mid
        dm, db = dm + low * m, db + low * b
        chosen.append((m, b, low))
    taken = stats.sparkSession.createDataFrame(chosen, "m bigint, b bigint, _k bigint")
    placed = ranked_first(groups.join(F.broadcast(taken), ["m", "b"]), ["m", "b"], "h", F.col("_k"))
    placed = placed.select("source", F.when(F.col("chosen"), "dev").otherwise("test").alias("split"))
    return join_unique(rows, placed, "source", "inner", hot_keys(rows, "source")).select("stat_id", "source", "split")


# ------------------------------------------------------------ look-up, voting


def digests(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", "path", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def priority_lookup(rows: DataFrame, row_id: str, keys: list[tuple[str, Column]], index: DataFrame) -> DataFrame:
    """Match rows to ``index(key, value)`` by the first kind of key that
    occurs in it; one join for all kinds of keys."""
    each = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(n).alias("match"), F.lower(c).alias("key")) for i, (n, c) in enumerate(keys)])
    long = rows.select(F.col(row_id).alias("id"), F.explode(each).alias("k")).select("id", "k.*").where("key is not null")
    hit = long.join(index, "key").groupBy("id").agg(F.min_by(F.struct("match", "value"), "p").alias("m"))
    return hit.select(F.col("id").alias(row_id), "m.match", "m.value")


def stat_index(stats: DataFrame) -> DataFrame:
    """Hash index of the experiment table: the first record of each hash."""
    long = stats.select("stat_id", F.explode(F.array(F.lower(F.trim("sha256")), F.lower(F.trim("sha1")), F.lower(F.trim("md5")))).alias("key"))
    return long.where("key is not null").groupBy("key").agg(F.min("stat_id").alias("value"))


# fixed values: words of detection names that are no family
NOISE_WORDS = (
    "trojan", "worm", "virus", "malware", "generic", "heur", "heuristic", "script", "gen", "variant", "agent",
    "downloader", "loader", "packed", "application", "win32", "w32", "acad", "autocad", "alisp", "lisp", "fas",
    "fascript", "trj", "classic", "suspicious", "unsafe", "unknown", "unclassifiedmalware", "securityrisk",
    "exploit", "als", "acm", "nil", "nim", "naa", "asm", "ai", "score", "probably",
)


def family_vote(stats: DataFrame) -> DataFrame:
    """Family word that the raw names speak for; the label's words count three
    times, ties go to the first in the alphabet."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    label = F.transform(words(F.col("vt_label")), lambda w: F.struct(w.alias("word"), F.lit(3).alias("n")))
    names = F.flatten(F.transform("vt_names", lambda x: F.transform(words(x), lambda w: F.struct(w.alias("word"), F.lit(1).alias("n")))))
    empty = F.array().cast("array<struct<word:string,n:int>>")
    each = stats.select("stat_id", F.explode(F.concat(F.coalesce(label, empty), F.coalesce(names, empty))).alias("v")).select("stat_id", "v.*")
    tells = (F.length("word") > 1) & ~F.col("word").rlike(r"^[0-9]") & ~F.col("word").isin(*NOISE_WORDS)
    votes = each.where(tells).groupBy("stat_id", "word").agg(F.sum("n").alias("votes"))
    best = votes.groupBy("stat_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "word")).alias("b"))
    return best.select("stat_id", F.col("b.word").alias("family"), (-F.col("b.v")).alias("votes"))


def family_recall(stats: DataFrame, threshold: float = 0.5) -> DataFrame:
    fam = F.lower(F.trim("family"))
    rows = stats.where("family is not null").select(fam.alias("family"), "stat_id", "family_source", (F.coalesce("current_risk", F.lit(0.0)) >= threshold).alias("hit"))
    return rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("detected"), F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("recall"), F.min_by("family_source", "stat_id").alias("first_source")
    )


def coverage(stats: DataFrame) -> DataFrame:
    """Records and hashes with metadata per input type, and overall."""
    rows = stats.groupBy(F.lower(F.trim("sha256")).alias("k"), F.lower("input_type").alias("input_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vt_match_type").isNotNull()).alias("m"), F.bool_or(F.col("family").isNotNull()).alias("f")
    )
    return rows.rollup("input_type").agg(
        F.sum("n").alias("records"), F.sum("m").alias("with_metadata"), F.count(F.lit(1)).alias("hash_groups"), F.count_if("f").alias("with_family")
    )


# ------------------------------------------------------- masking, comparisons


def mask_runs(tokens: DataFrame, levels=(0.0, 0.1, 0.3, 0.4, 0.5, 0.6), seeds: int = 10, base_seed: int = 20260418) -> DataFrame:
    """Share of what is left when part of the tokens is masked, mean and
    population deviation over seeds.

    ``tokens(token, n, total)`` is aggregated per token before seeds multiply
    it; of ``m`` tokens, ``round(f * m)`` (one at least where f is positive)
    with the least digests are masked.  What lies below a limit comes from a
    histogram over the leading digits; only its last bucket is ranked.
    """
    each = tokens.select("token", "n", "total", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("run"))
    each = each.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(base_seed)), F.col("run").cast("string"), F.col("token")))).withColumn("b", F.substring("h", 1, 4))
    hist = each.groupBy("run", "b").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    w = Window.partitionBy("run").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in ("k", "n", "total")], *[F.sum(c).over(Window.partitionBy("run")).alias(f"{c}_all") for c in ("k", "n", "total")])
    level = F.col("level")
    limit = F.greatest(F.round(F.col("k_all") * level), F.when(level > 0, 1).otherwise(0))
    marked = hist.withColumn("level", F.explode(F.array(*[F.lit(float(f)) for f in levels]))).withColumn("limit", limit)
    # the bucket in which the limit lies, or the first one where nothing is masked
    at = marked.where((F.col("k_before") < F.col("limit")) & (F.col("k_before") + F.col("k") >= F.col("limit")) | (F.col("limit") == 0) & (F.col("k_before") == 0))
    at = at.select("level", "run", "b", (F.col("limit") - F.col("k_before")).alias("inside"), "n_before", "total_before", "n_all", "total_all")
    edge = each.join(F.broadcast(at), ["run", "b"])  # a row per level and seed
    ranked = edge.withColumn("masked", F.row_number().over(Window.partitionBy("level", "run", "b").orderBy("h")) <= F.col("inside"))
    per = ranked.groupBy("level", "run").agg(*[
        (1 - (F.first(f"{c}_before") + F.sum(F.when(F.col("masked"), F.col(c)).otherwise(0))) / F.first(f"{c}_all")).alias(x) for c, x in (("n", "kept_rows"), ("total", "kept_total"))
    ])
    return per.groupBy("level").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("kept_rows"), 6).alias("rows_mean"), F.round(F.stddev_pop("kept_rows"), 6).alias("rows_std"),
        F.round(F.avg("kept_total"), 6).alias("total_mean"), F.round(F.stddev_pop("kept_total"), 6).alias("total_std"),
    )


def set_compare(expected: DataFrame, recovered: DataFrame, *by: str) -> DataFrame:
    """Matched, missed and unexpected items, recall and precision per key;
    both sides are sets."""
    e, r = expected.select(*by, "item").distinct().withColumn("e", F.lit(True)), recovered.select(*by, "item").distinct().withColumn("r", F.lit(True))
    both = e.join(r, [*by, "item"], "full")
    agg = both.groupBy(*by).agg(F.count_if(F.col("e") & F.col("r")).alias("matched"), F.count_if(F.col("e") & F.col("r").isNull()).alias("missed"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    return agg.select(
        *by, "matched", "missed", "unexpected", F.round(safe_divide(F.col("matched"), F.col("matched") + F.col("missed")), 6).alias("recall"),
        F.round(safe_divide(F.col("matched"), F.col("matched") + F.col("unexpected")), 6).alias("precision"),
    )


def set_summary(compared: DataFrame) -> DataFrame:
    """Micro averages over all keys."""
    s = compared.agg(F.sum("matched").alias("matched"), F.sum("missed").alias("missed"), F.sum("unexpected").alias("unexpected"))
    return s.select("*", F.round(safe_divide(F.col("matched"), F.col("matched") + F.col("missed")), 6).alias("recall"), F.round(safe_divide(F.col("matched"), F.col("matched") + F.col("unexpected")), 6).alias("precision"))


def folded(definitions: DataFrame, uses: DataFrame, external: DataFrame) -> DataFrame:
    """Definitions that stay: those no other one consumes, or used outside.

    ``definitions(name)``, ``uses(name, dep)`` (name is built from dep),
    ``external(name)``.
    """
    consumed = uses.where("name <> dep").select(F.col("dep").alias("name")).distinct()
    inner = definitions.join(consumed, "name", "left_semi").join(external.select("name").distinct(), "name", "left_anti")
    return definitions.join(inner.select("name"), "name", "left_anti").distinct()


def stem(path: Column) -> Column:
    """File name in lower case without extension and numbering."""
    return F.regexp_replace(F.regexp_replace(F.lower(basename(path)), r"\.[a-z0-9]+$", ""), r"_[0-9]+$", "")


def strict_pairs(samples: DataFrame) -> DataFrame:
    """Compiled files paired with a source of the same stem (the first by
    path), unpaired ones with null; unpaired sources as well."""
    kind = F.when(F.lower("ext") == ".fas", "compiled").when(F.lower("ext") == ".lsp", "source")
    rows = samples.select("path", stem(F.col("path")).alias("stem"), kind.alias("kind")).where("kind is not null").distinct()
    first = rows.groupBy("stem", "kind").agg(F.min("path").alias("path"))
    a = first.where("kind = 'compiled'").select("stem", F.col("path").alias("compiled"))
    b = first.where("kind = 'source'").select("stem", F.col("path").alias("source"))
    return a.join(b, "stem", "full")


def overlap_pairs(left: DataFrame, right: DataFrame, top: int = 3, hot: int = 1_000) -> DataFrame:
    """Best ``top`` right items per left item by the number of shared tokens;
    tokens with a namespace count three.  ``left/right(item, token)``.

    Tokens of more than ``hot`` right items are joined last, and not for every
    left item: where the ``top`` best by rare tokens alone beat all that hot
    tokens could give, only those candidates' hot tokens are counted.  Items
    left over are joined on hot tokens in full, so the result is exact.
    """
    a, b = left.select("item", "token").distinct(), right.select(F.col("item").alias("other"), "token").distinct()
    weight = F.when(F.col("token").contains(":"), 3).otherwise(1)
    often = staged(b.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("token"))
    rare = a.join(often, "token", "left_anti").join(b, "token").where("item <> other").groupBy("item", "other").agg(F.sum(weight).alias("score"))
    if not often.isEmpty():
        rare = staged(rare)
        hot_a, hot_b = staged(a.join(often, "token", "left_semi")), staged(b.join(often, "token", "left_semi"))
        most = hot_a.groupBy("item").agg(F.sum(weight).alias("most"))
        by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), "other")
        nth = rare.withColumn("k", F.row_number().over(by_score)).where(F.col("k") == top).select("item", F.col("score").alias("nth"))
        settled = staged(most.join(nth, "item", "left").select("item", (F.coalesce("nth", F.lit(0)) > F.col("most")).alias("settled")))
        rest = hot_a.join(settled.where("not settled"), "item", "left_semi").join(hot_b, "token").where("item <> other")
        known = hot_a.join(settled.where("settled"), "item", "left_semi").join(rare.select("item", "other"), "item").join(hot_b, ["other", "token"], "left_semi")
        extra = rest.select("item", "other", "token").unionByName(known.select("item", "other", "token")).groupBy("item", "other").agg(F.sum(weight).alias("score"))
        rare = rare.unionByName(extra).groupBy("item", "other").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), "other")
    ranked = rare.withColumn("position", F.row_number().over(w).cast("bigint")).withColumn("next", F.lead("score").over(w))
    first = (F.col("position") == 1) & (F.col("next").isNull() | (F.col("next") < F.col("score")))
    return ranked.withColumn("accepted", first).where(F.col("position") <= top).drop("next")


def label_score(label: Column, confidence: Column) -> Column:
    """A model's label as a score: half plus or minus half the confidence."""
    c = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(label == "MALICIOUS", 0.5 + 0.5 * c).when(label == "BENIGN", 0.5 - 0.5 * c).otherwise(0.5)

