"""Operators over the effect table: dedup and caps, tags, lifting, targets,
propagation evidence, per-function summaries.

``effects(sample_id, seq, fn, effect_type, target, source, meta, line)``
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import vocabulary as V
from triagelake.session import staged

EFFECT_COLUMNS = ("sample_id", "seq", "fn", "effect_type", "target", "source", "meta", "line")


def any_in(c: Column, words) -> Column:
    """Whether the text holds any of the words."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def any_equal(c: Column, words) -> Column:
    return c.isin(*words)


def effects_of(facts: DataFrame) -> DataFrame:
    """Effect rows of a fact table."""
    return facts.where("fact = 'effect'").select(
        "sample_id", "seq", "fn", F.col("name").alias("effect_type"), "target", "source", "meta", "line"
    )


def dedup_cap(effects: DataFrame, key: str = "sample_id", order: str = "seq", limit: int = V.MAX_EFFECTS) -> DataFrame:
    """First of each (type, target, source) per key, at most ``limit`` a key.

    Rows without type or target are dropped.  The first occurrence comes from
    a pre-aggregated minimum, so a hot key is reduced before it is ranked.
    """
    identity = ["effect_type", "target", "source"]
    named = effects.where("effect_type <> '' and target <> ''")
    rest = [c for c in effects.columns if c not in (key, *identity)]
    first = named.groupBy(key, *identity).agg(F.min_by(F.struct(*rest), order).alias("r"), F.min(order).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_o"))
    return first.withColumn("_k", rank).where(F.col("_k") <= limit).select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in effects.columns])


def tags(effects: DataFrame, key: str = "sample_id") -> DataFrame:
    """Distinct semantic tags per key and (type, target)."""
    table = F.create_map(*[x for k, v in V.TAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return (
        effects.select(key, "effect_type", "target", F.explode(F.try_element_at(table, F.col("effect_type"))).alias("tag"))
        .distinct()
        .select(key, F.concat_ws(":", "effect_type", "target").alias("effect_key"), "tag")
    )


def lifted(effects: DataFrame, rules=V.LIFT_RULES) -> DataFrame:
    """The first lifting rule that matches each effect, in table order.

    The rules are a constant of the plan, so matching is a chain of
    expressions in the scan stage and no join.
    """
    kind = F.when(F.col("effect_type") == "registry_modify", "registry_write").when(
        F.col("effect_type").isin("file_write", "process_create", "com_create", "com_invoke", "env_check", "network_connect"), F.col("effect_type")
    )
    kind = F.coalesce(kind, F.lit("unknown"))
    target, fn = F.col("target"), F.col("source")
    chosen = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        _, rtype, func, obj, method, prop, path, key, *_ = rules[k]
        hit = kind == rtype
        if func is not None:
            hit = hit & (F.lower(fn) == func)
        if obj is not None:
            hit = hit & (F.lower(fn) == obj)
        if method is not None or prop is not None:
            hit = hit & F.lit(False)  # calls carry no method or property
        if path is not None:
            hit = hit & target.rlike(path)
        if key is not None:
            hit = hit & target.rlike(key)
        chosen = F.when(hit, F.lit(k)).otherwise(chosen)
    row = F.array(*[F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[8]).alias("lifted_type"), F.lit(r[9]).alias("severity"), F.lit(r[10]).alias("confidence")) for r in rules])
    com_init = F.lower(fn) == "vl-load-com"
    picked = effects.withColumn("_k", chosen).withColumn("_r", F.when(F.col("_k").isNotNull(), F.get(row, F.col("_k"))))
    return picked.select(
        *effects.columns,
        F.coalesce("_r.rule_id", F.lit("DEFAULT")).alias("rule_id"),
        F.coalesce("_r.lifted_type", F.upper("effect_type")).alias("lifted_type"),
        F.coalesce("_r.severity", F.when(com_init, "low").otherwise("medium")).alias("severity"),
        F.coalesce("_r.confidence", F.when(com_init, 0.2).otherwise(0.6)).alias("lift_confidence"),
    )


# ------------------------------------------------------------------ targets


def startup_target(c: Column, variant: str = "rules") -> Column:
    """Whether a target is run at start; the variants differ on purpose."""
    t = F.lower(c)
    files, pattern = any_in(t, V.STARTUP_FILES), t.rlike(V.STARTUP_PATTERN)
    if variant == "rules":
        return files | t.contains(".mnl") | t.contains("startup") | pattern
    if variant == "scoring":
        return files | t.contains("startup") | pattern
    if variant == "context":
        return any_in(c, ("acad.lsp", "acaddoc.lsp", "startup", ".mnl")) | c.rlike("(?i)" + V.STARTUP_PATTERN)
    if variant == "evidence":
        return any_in(t, ("acad.lsp", "acaddoc.lsp", "startup", ".mnl"))
    raise ValueError(variant)


def target_kind(c: Column) -> Column:
    """Kind of a target, first match wins."""
    t = F.lower(c)
    return (
        F.when(startup_target(c, "evidence"), "startup")
        .when(any_in(t, ("menu", ".mnu")), "menu")
        .when(t.rlike(r"\.(lsp|fas|vlx|scr)$"), "code")
        .when(t.contains("registry"), "registry")
        .when(any_in(t, ("config", ".ini")) | t.endswith(".cfg"), "config")
        .when(t.rlike(r"\.(exe|dll|bat|cmd)$"), "executable")
        .otherwise("other")
    )


def target_severity(effect_type: Column) -> Column:
    return (
        F.when(effect_type.isin("file_write", "file_delete", "registry_modify", "registry_delete"), "high")
        .when(effect_type.isin("file_read", "registry_read"), "medium")
        .when(effect_type.isin("process_create", "command_hijack"), "critical")
        .otherwise("low")
    )


def targets(effects: DataFrame) -> DataFrame:
    """Propagation targets: one row per effect with a target."""
    entry = F.col("fn").rlike("^c:.") | (F.col("fn") == "S::STARTUP") | F.col("fn").contains("reactor")
    return effects.where("target <> ''").select(
        "sample_id",
        F.col("target").alias("path"),
        target_kind(F.col("target")).alias("kind"),
        target_severity(F.col("effect_type")).alias("severity"),
        F.coalesce("fn", F.lit("unknown")).alias("fn"),
        F.col("source").alias("origin"),
        entry.alias("from_entry"),
        "line",
    )


def propagation(effects: DataFrame, key: str = "sample_id") -> DataFrame:
    """Propagation evidence per key, in one aggregation."""
    t = F.lower("target")
    writes = F.col("effect_type").isin("file_write", "file_delete", "file_hidden")
    start, network_path = startup_target(F.col("target"), "evidence"), t.contains("\\\\") | any_in(t, ("//", "network", "share"))
    other_user = t.contains("\\users\\") & ~t.contains("\\users\\public")
    agg = effects.where("target <> ''").groupBy(key).agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(writes).alias("complexity"),
        F.count_distinct(F.when(writes, F.col("target"))).alias("write_paths"),
        F.count_distinct(F.when(F.col("effect_type") == "file_read", F.col("target"))).alias("source_paths"),
        F.count_distinct(F.coalesce("fn", F.lit("unknown"))).alias("methods"),
        F.bool_or(writes & start).alias("startup_write"),
        F.bool_or(start).alias("startup"),
        F.bool_or(any_in(t, ("load", "require"))).alias("autoload"),
        F.bool_or(F.col("effect_type").isin("command_hijack", "command_undefine")).alias("hijack"),
        F.bool_or(F.col("effect_type") == "network_connect").alias("network"),
        F.bool_or(network_path | other_user).alias("lateral"),
    )
    worm = (F.col("write_paths") >= 2) & (F.col("startup_write") | F.col("hijack") | F.col("network"))
    grade = (
        F.when(~worm, "none").when(F.col("complexity") >= 5, "high").when(F.col("complexity") >= 3, "medium").when(F.col("complexity") >= 1, "low").otherwise("none")
    )
    likely = worm | F.col("lateral") | (F.col("startup") & F.col("autoload")) | (F.col("hijack") & F.col("startup"))
    return agg.select(
        key, "targets", "complexity", "write_paths", "source_paths", "methods", worm.alias("is_worm"), grade.alias("replication"),
        F.col("lateral").alias("lateral_movement"), (F.col("startup") | F.col("autoload")).alias("local_autoload"), likely.alias("propagation_likely"),
    )


def entry_points(functions: DataFrame) -> DataFrame:
    """Functions that run without being called; a name may count twice."""
    n = F.col("fn")
    kinds = F.array_compact(
        F.array(
            F.when(n.rlike("^c:."), F.lit("command")),
            F.when(n == "S::STARTUP", F.lit("startup")),
            F.when(n.contains("VLR-") | n.contains("reactor"), F.lit("reactor")),
        )
    )
    return functions.select("sample_id", "fn", F.explode(kinds).alias("kind"))


def direct_effects(effects: DataFrame) -> DataFrame:
    """Effect types per function with their counts (a bag)."""
    return effects.groupBy("sample_id", "fn", "effect_type").agg(F.count(F.lit(1)).alias("n"))


def all_effects(effects: DataFrame, edges: DataFrame) -> DataFrame:
    """Own effects of a function (with counts) and those it inherits from the
    functions it reaches (each type once, unless it is its own).

    Effect types go from callee to caller along ``edges(sample_id, caller,
    callee)`` until none is new, so what is held is a row per function and
    type, not one per pair of functions.
    """
    own = direct_effects(effects)
    up = staged(edges.select("sample_id", F.col("callee").alias("fn"), "caller").distinct())
    have = new = staged(own.select("sample_id", "fn", "effect_type"))
    rounds = 0
    while True:
        rounds += 1
        given = new.join(up, ["sample_id", "fn"]).select("sample_id", F.col("caller").alias("fn"), "effect_type").distinct()
        new = staged(given.join(have, ["sample_id", "fn", "effect_type"], "left_anti"))
        if new.isEmpty():
            break
        have = have.unionByName(new)
        if rounds % 8 == 0:
            have = staged(have)
    both = own.withColumn("own", F.lit(True)).unionByName(have.select("*", F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("own")))
    return both.groupBy("sample_id", "fn", "effect_type").agg(
        F.coalesce(F.max(F.when(F.col("own"), F.col("n"))), F.lit(1)).alias("n"), F.bool_or("own").alias("own")
    )


def behaviours(function_effects: DataFrame) -> DataFrame:
    """Behaviours that the effects of a function imply."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("effect_type") == kind, F.col("n"))), F.lit(0))
    flags = function_effects.groupBy("sample_id", "fn").agg(
        n("file_write").alias("writes"), n("command_undefine").alias("undefines"), n("registry_modify").alias("registry"), n("data_destroy").alias("destroys")
    )
    fn = F.col("fn")
    found = F.array_compact(
        F.array(
            F.when((F.col("writes") >= 2) & fn.rlike("^(s::startup|chklsp|writelsp)"), F.lit("self_replication")),
            F.when((F.col("undefines") >= 1) & fn.rlike("^c:"), F.lit("command_hijack")),
            F.when((F.col("registry") >= 1) & (F.col("writes") >= 1), F.lit("stealth_persistence")),
            F.when((F.col("writes") >= 3) & fn.startswith("s::"), F.lit("worm")),
            F.when(F.col("destroys") >= 1, F.lit("destructive_payload")),
        )
    )
    return flags.select("sample_id", "fn", F.explode(found).alias("behaviour"))


def function_types(calls: DataFrame) -> DataFrame:
    """Result type that a call's function name tells."""
    n = F.lower("name")
    kind = (
        F.when(n == "open", "file_handle")
        .when(n.isin("vlax-create-object", "vlax-get-or-create-object", "vlax-get-object"), "com_object")
        .when(n.isin("strcat", "strcase", "substr", "itoa", "rtos", "chr", "read-line", "getenv", "findfile"), "string")
        .when(n.isin("atoi", "atof", "strlen", "+", "-", "*", "/", "1+", "1-", "length", "ascii"), "number")
        .when(n.isin("=", "/=", "<", ">", "<=", ">=", "and", "or", "not", "null", "equal"), "boolean")
        .when(n.isin("list", "cons", "append", "cdr", "mapcar", "vl-directory-files"), "list")
        .otherwise("unknown")
    )
    return calls.select("*", kind.alias("ir_type"))
