"""Evidence to risk, verdict and fused verdict: column expressions and one
aggregation per kind of evidence."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import vocabulary as V
from triagelake.operators.effects import any_in, startup_target
from triagelake.operators.rules import suspicious_command, suspicious_registry


@dataclass(frozen=True)
class Parameters:
    """Weights, slope, threshold and floors of the score."""

    rule: float = 0.30
    attack: float = 0.25
    feature: float = 0.25
    formal: float = 0.20
    slope: float = 4.0
    threshold: float = 0.5
    floors: dict = field(default_factory=lambda: dict(V.RISK_FLOORS))
    multipliers: dict = field(default_factory=dict)
    floor_factor: float = 1.0


def write_severity(target: Column, source: Column) -> Column:
    t, s = F.lower(target), F.lower(source)
    temp = ("tmp", "temp", ".dcl")
    return (
        F.when(any_in(t, temp) | any_in(s, temp), 0.3)
        .when(t.isin("fn", "tmp", "temp", "f"), 0.0)
        .when(startup_target(t, "scoring") | t.contains("runonce"), 0.9)
        .otherwise(0.6)
    )


_SHELLS = ("wscript.shell", "shell.application", "adodb.stream", "adodb.connection", "vbscript", "scriptlet")
# fixed values: words of ordinary work with the host's objects
_ORDINARY = (
    "vla-", "vlax-", "getattributes", "gettextstring", "insertionpoint", "effectivename", "getboundingbox", "getpoint",
    "getentity", "getselection", "addline", "addcircle", "addtext", "addmtext", "add", "get", "put", "delete", "item",
    "count", "explode", "active", "document", "modelspace", "paperspace", "blocks", "layer", "color", "linetype",
    "coordinates", "normal", "objectname", "startangle", "endangle", "radius", "height",
)


def create_severity(target: Column, source: Column) -> Column:
    t, s = F.lower(target), F.lower(source)
    return (
        F.when(s.contains("vl-load-com"), 0.02)
        .when(any_in(t, ("wscript", *_SHELLS)), 0.85)
        .when(any_in(t, ("xmlhttp", "msxml")), 0.55)
        .when(t.contains("filesystemobject"), 0.25)
        .otherwise(0.5)
    )


def invoke_severity(target: Column, source: Column, vba_rule: Column) -> Column:
    t, s = F.lower(target), F.lower(source)
    in_either = lambda words: any_in(t, words) | any_in(s, words)
    starts = reduce(lambda a, b: a | b, [s.startswith(w) for w in _ORDINARY])
    base = (
        F.when(in_either(_SHELLS), 0.8)
        .when(in_either(("xmlhttp", "msxml")), 0.55)
        .when(in_either(("filesystemobject",)), 0.2)
        .when(in_either(("insertlines", "addfromstring", "codemodule", "vbproject", "vbcomponents")), 0.92)
        .when(starts | any_in(t, _ORDINARY), 0.2)
        .otherwise(0.5)
    )
    base = F.when(any_in(t, ("insertlines", "codemodule", "addfromstring")), 0.95).otherwise(base)
    return F.when(vba_rule & s.contains("vlax-invoke"), 0.90).otherwise(base)


def effect_severity(vba_rule: Column | None = None) -> Column:
    k, t, s = F.col("effect_type"), F.col("target"), F.col("source")
    vba = F.lit(False) if vba_rule is None else F.coalesce(vba_rule, F.lit(False))
    return (
        F.when(k == "file_write", write_severity(t, s))
        .when(k == "registry_modify", F.when(suspicious_registry(t), 0.9).otherwise(0.25))
        .when(k == "process_create", F.when(suspicious_command(t), 0.9).otherwise(0.35))
        .when(k == "network_connect", 0.65)
        .when(k == "com_create", create_severity(t, s))
        .when(k == "com_invoke", invoke_severity(t, s, vba))
        .when(k == "command_hijack", 0.85)
        .when(k.isin("file_read", "registry_read"), 0.3)
        .otherwise(0.5)
    )


def entropy(effects: DataFrame, key: str = "sample_id", kind: str = "effect_type") -> DataFrame:
    """Shannon entropy of the kinds per key, over log2 of their number."""
    n = effects.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    h = F.log2("total") - F.col("nlogn") / F.col("total")
    return per.select(key, "total", "kinds", F.when(F.col("kinds") > 1, h / F.log2("kinds")).otherwise(0.0).alias("entropy"))


def weights(p: Parameters, formal: Column) -> list[Column]:
    """Weights of rule, technique, feature and formal evidence; without
    formal evidence its weight goes to the others in proportion."""
    rest = p.rule + p.attack + p.feature
    scale = (rest + p.formal) / rest if rest > 0 else 1.0
    none = (formal <= 0) if p.formal > 0 else F.lit(False)
    each = [F.when(none, w * scale).otherwise(F.lit(w)) for w in (p.rule, p.attack, p.feature)]
    return [*each, F.when(none, 0.0).otherwise(F.lit(p.formal))]


def risk(p: Parameters, rule: Column, attack: Column, feature: Column, formal: Column, context: Column, floor: Column) -> Column:
    """Sigmoid of the weighted evidence, raised by context and by the floor."""
    w = weights(p, formal)
    combined = w[0] * rule + w[1] * attack + w[2] * feature + w[3] * formal
    base = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-p.slope) * (combined - F.lit(0.5))))
    base = F.when(context > 0.7, F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    return F.greatest(base, floor)


def floor_of(rule_id: Column, p: Parameters) -> Column:
    if not p.floors:
        return F.lit(0.0)
    table = F.create_map(*[x for k, v in p.floors.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(table, rule_id), F.lit(0.0)) * F.lit(p.floor_factor)


def multiplier_of(rule_id: Column, p: Parameters) -> Column:
    if not p.multipliers:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in p.multipliers.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(table, rule_id), F.lit(1.0))


def rule_evidence(hits: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Mean severity over hits (repeated hits count), the highest floor."""
    n = F.col("hits")
    return hits.groupBy("sample_id").agg(
        (F.sum(F.col("severity") * multiplier_of(F.col("rule_id"), p) * n) / F.sum(n)).alias("rule_evidence"),
        F.max(floor_of(F.col("rule_id"), p)).alias("floor"),
        F.bool_or(F.col("rule_id") == "VBA_INJECT_001").alias("vba_rule"),
        F.sum(n).alias("rules"),
    )


def formal_evidence(predicates: DataFrame, final: DataFrame) -> DataFrame:
    """Half the confidence of satisfied predicates, and a high formal score."""
    p = predicates.groupBy("sample_id").agg(F.sum(F.when(F.col("satisfied"), F.col("confidence") * 0.5).otherwise(0.0)).alias("p"))
    both = p.join(final.select("sample_id", F.col("formal_score").alias("f")), "sample_id", "full")
    f = F.coalesce("f", F.lit(0.0))
    return both.select("sample_id", F.least(F.lit(1.0), F.coalesce("p", F.lit(0.0)) + F.when(f > 0.5, f * 0.3).otherwise(0.0)).alias("formal_evidence"))


def formal_score(metrics: DataFrame, spreads: DataFrame, effects: DataFrame) -> DataFrame:
    """.3 strongest cycle + .3 best coverage + .2 entropy + .2 checks."""
    m = metrics.groupBy("sample_id").agg(F.max("strength").alias("strength"))
    s = spreads.groupBy("sample_id").agg(F.max("coverage").alias("coverage"))
    e = entropy(effects).select("sample_id", "entropy")
    c = effects.groupBy("sample_id").agg(F.least(F.lit(1.0), F.count_if(F.col("effect_type") == "env_check") / 5).alias("checks"))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return c.join(e, "sample_id", "left").join(m, "sample_id", "left").join(s, "sample_id", "left").select(
        "sample_id", (0.3 * z("strength") + 0.3 * z("coverage") + 0.2 * z("entropy") + 0.2 * F.col("checks")).alias("formal_score")
    )


def context_score(effects: DataFrame, tags: DataFrame, lifted: DataFrame) -> DataFrame:
    """Environment, persistence and execution parts, each capped at 1."""

    def table(pairs: dict[str, float], rest: float) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]), F.col("tag")), F.lit(rest))

    by_tag = tags.groupBy("sample_id").agg(
        F.sum(table({"ENV_CHECK": 0.5, "MAC_CHECK": 0.3, "DATE_CHECK": 0.2, "HOST_ID": 0.5, "FILE_CONTEXT": 0.3, "APP_CONTEXT": 0.2}, 0.1)).alias("te"),
        F.sum(table({"STARTUP_HOOK": 0.4, "REGISTRY_MOD": 0.3, "SELF_REPLICATION": 0.5, "AUTOLOAD": 0.4}, 0.1)).alias("tp"),
        F.sum(table({"PROCESS_EXEC": 0.6, "SHELL_EXEC": 0.2, "COM_INVOKE": 0.1, "CODE_EXEC": 0.15, "DYNAMIC_EVAL": 0.15}, 0.05)).alias("tx"),
    )
    k, t, s = F.col("effect_type"), F.lower("target"), F.lower("source")
    start = startup_target(t, "context")
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    loads = F.coalesce(F.try_element_at("meta", F.lit("code_load")) == "true", F.lit(False))
    env = part(any_in(s, ("getvar", "getenv")), 0.3)
    persist = (
        part((k == "file_write") & (start | t.contains("acaddoc")), 1.0)
        + part(k.contains("registry"), 0.3)
        + part(k.contains("com") & (t.contains("startup") | s.contains("startup")), 0.4)
        + part((k == "file_write") & s.contains("write") & start, 0.8)
    )
    execute = (
        part(k.contains("process") | k.contains("command"), 0.6)
        + part(any_in(s, ("shell", "cmd", "wscript")), 0.2)
        + part(k.contains("com"), 0.1)
        + part(s.contains("eval"), 0.15)
        + part(s.contains("load"), 0.1)
        + part(s.contains("load") & start, 0.35)
        + part(loads, 0.15)
        + part(loads & start, 0.25)
    )
    by_effect = effects.groupBy("sample_id").agg(F.sum(env).alias("ee"), F.sum(persist).alias("ep"), F.sum(execute).alias("ex"))
    lt, lk = F.lower("target"), F.lower("lifted_type")
    by_lift = lifted.groupBy("sample_id").agg(
        F.sum(part(lk.contains("persistence") & (startup_target(lt, "context") | lt.contains("acaddoc")), 1.0)).alias("lp"),
        F.sum(part(lk.contains("process") | lk.contains("exec"), 0.6) + part(lk.contains("code"), 0.15)).alias("lx"),
    )
    z = lambda *x: F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in x]))
    joined = by_effect.join(by_tag, "sample_id", "left").join(by_lift, "sample_id", "left")
    parts = joined.select("sample_id", z("te", "ee").alias("env_awareness"), z("tp", "ep", "lp").alias("persistence"), z("tx", "ex", "lx").alias("execution"))
    return parts.withColumn("context_score", F.least(F.lit(1.0), 0.3 * F.col("env_awareness") + 0.35 * F.col("persistence") + 0.35 * F.col("execution")))


def verdict(risk: Column, threshold: Column | float = 0.5) -> Column:
    return F.when(risk >= threshold, "MALICIOUS").otherwise("BENIGN")


def fused_verdict(rule_verdict: Column, risk: Column, threshold: Column, label: Column, confidence: Column) -> tuple[Column, Column]:
    """Verdict and reason from the score and a model's label."""
    strong = (rule_verdict == "MALICIOUS") & (risk >= threshold + 0.15)
    escalate = (label == "MALICIOUS") & (confidence >= 0.9) & (risk >= threshold * 0.6)
    none = label.isNull() | (label == "")
    v = (
        F.when(none | (label == rule_verdict), rule_verdict)
        .when(strong, "MALICIOUS")
        .when((rule_verdict == "BENIGN") & escalate, "MALICIOUS")
        .otherwise("SUSPICIOUS")
    )
    why = (
        F.when(none, "rule-only").when(label == rule_verdict, "agree").when(strong, "strong-rule").when((rule_verdict == "BENIGN") & escalate, "semantic-escalation").otherwise("rule-llm-disagreement")
    )
    return v, why
