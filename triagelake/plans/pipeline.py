"""The whole triage pipeline as one plan over the samples table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import text as X
from triagelake.operators import effects as E
from triagelake.operators import graph as G
from triagelake.operators import recovery as V
from triagelake.operators import rules as R
from triagelake.operators import scoring as S
from triagelake.operators import techniques as T
from triagelake.session import staged, together
from triagelake.sources import bytecode as B
from triagelake.sources import lisp


@dataclass
class Facts:
    """Fact tables of a set of samples, all keyed by sample."""

    nodes: DataFrame
    effects: DataFrame
    functions: DataFrame
    calls: DataFrame
    aliases: DataFrame


@dataclass
class Recovered:
    """What is recovered from compiled files."""

    effects: DataFrame
    functions: DataFrame
    calls: DataFrame
    aliases: DataFrame
    evidence: DataFrame


def recovered(files: DataFrame, resources: DataFrame) -> Recovered:
    """Functions, calls, names and effects of compiled files.

    ``files(sample_id, code, symbols, strings)`` are decoded streams,
    ``resources(sample_id, idx, value)`` their resource entries.  Effects are
    those of behaviours first, then those of indicators.  Files with very many
    functions or names keep their effects and go without a graph.
    """
    instr = staged(B.instructions(files))
    pool = files.select("sample_id", F.explode("strings").alias("value")).unionByName(resources.select("sample_id", "value"))
    shown = staged(B.behaviours(instr, pool))
    heavy = V.light_mode(B.frames(instr), B.bindings(instr)).where("light").select("sample_id")
    graph = lambda rows: rows.join(heavy, "sample_id", "left_anti")
    summary = B.summary_effects(B.resource_summary(resources))
    effects = V.behaviour_effects(shown).unionByName(summary.withColumn("seq", F.col("seq").cast("int") + 1_000))
    return Recovered(effects, graph(B.recovered_functions(instr)), graph(B.recovered_calls(instr)), graph(B.recovered_aliases(instr)), V.recovered_evidence(shown))


def once(samples: DataFrame) -> DataFrame:
    """One row per sample, all of it from the one with the first path."""
    if "path" not in samples.columns:
        return samples.dropDuplicates(["sample_id"])
    first = samples.groupBy("sample_id").agg(F.min("path").alias("path"))
    return samples.join(first, ["sample_id", "path"], "left_semi")


def script_facts(samples: DataFrame, extra: Recovered | None = None) -> Facts:
    """One pass over the texts; each kind of fact is a partition of its own,
    so a reader of one kind opens no file of the others.

    Macro sources, told by their content, are read as a script that does what
    they do.  What is recovered from compiled files comes after the scripts'
    own facts and is part of the same graph.
    """
    text = F.when(X.is_vba(F.col("text")), X.macro_script(F.col("text"))).otherwise(F.col("text"))
    read = once(samples).select("sample_id", text.alias("text"))
    rows = staged(lisp.facts(read), "fact")
    functions = rows.where("fact = 'function'").select("sample_id", "fn")
    calls = rows.where("fact = 'call'").select("sample_id", "fn", "name", "line")
    aliases = rows.where("fact = 'alias'").select("sample_id", "fn", "name", "target")
    if extra is not None:
        functions, calls, aliases = functions.unionByName(extra.functions), calls.unionByName(extra.calls), aliases.unionByName(extra.aliases)
    effects = staged(V.merge_effects(E.effects_of(rows), *([extra.effects] if extra is not None else [])))
    return Facts(rows.where("fact = 'node'"), effects, functions, calls, aliases)


def formal(f: Facts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predicates, formal score, motifs) from call graph and effects."""
    edges, entries = together(lambda: staged(G.call_targets(f.calls, f.functions, f.aliases)), lambda: staged(E.entry_points(f.functions)))
    metrics, spreads = together(
        lambda: staged(G.component_metrics(G.strong_components(edges), edges, f.effects)), lambda: staged(G.spread(G.closure(edges, entries), entries, f.effects))
    )
    predicates = G.worm_predicate(metrics).unionByName(G.stealth_predicate(f.effects)).unionByName(G.spread_predicate(spreads))
    motifs = G.cycle_motifs(metrics, G.back_edges(edges)).unionByName(G.chain_motifs(f.effects, edges))
    return predicates, S.formal_score(metrics, spreads, f.effects), motifs


def scores(samples: DataFrame, p: S.Parameters = S.Parameters(), extra: Recovered | None = None) -> DataFrame:
    """Evidence, risk and verdict of every sample with a text, or with
    effects recovered from its compiled form."""
    f = script_facts(samples, extra)
    nodes = R.top_nodes(f.nodes)
    hits, found, (predicates, final, _) = together(lambda: staged(R.rule_hits(f.effects, nodes)), lambda: staged(T.techniques(f.effects, nodes)), lambda: formal(f))
    by_rule = S.rule_evidence(hits, p)
    named = found.where(F.col("technique").isin(*[t[0] for t in T.V.TECHNIQUES]))
    by_technique = named.groupBy("sample_id").agg(F.avg("confidence").alias("attack_evidence"), F.count(F.lit(1)).alias("techniques"))
    severity = f.effects.join(by_rule.select("sample_id", "vba_rule"), "sample_id", "left").select("sample_id", S.effect_severity(F.col("vba_rule")).alias("x"))
    by_effect = severity.groupBy("sample_id").agg(F.avg("x").alias("feature_evidence"), F.count(F.lit(1)).alias("effects"))
    context = S.context_score(f.effects, E.tags(f.effects), E.lifted(f.effects))
    first = F.min_by(F.struct("path", "input_type", F.col("text").isNotNull().alias("t")), "path")
    base = samples.groupBy("sample_id").agg(first.alias("r")).where("true" if extra is not None else "r.t").select("sample_id", "r.path", "r.input_type", F.lit(True).alias("_here"))
    # each part has one row a sample: one aggregate puts them side by side
    parts = [base, by_rule.drop("vba_rule"), by_technique, T.technique_risk(found), by_effect, S.formal_evidence(predicates, final), context]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    base = rows.groupBy("sample_id").agg(*[F.max(c).alias(c) for c in rows.columns if c != "sample_id"]).where("_here")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    risk = S.risk(p, z("rule_evidence"), z("attack_evidence"), z("feature_evidence"), z("formal_evidence"), z("context_score"), z("floor"))
    out = base.select(
        "sample_id", "path", "input_type", F.coalesce("rules", F.lit(0)).cast("int").alias("rule_count"), F.coalesce("techniques", F.lit(0)).cast("int").alias("techniques"),
        F.coalesce("effects", F.lit(0)).cast("int").alias("effects"), *[F.round(z(c), 6).alias(c) for c in ("rule_evidence", "attack_evidence", "feature_evidence", "formal_evidence", "context_score", "attack_risk")],
        F.round(risk, 6).alias("risk"),
    )
    return out.withColumn("verdict", S.verdict(F.col("risk"), p.threshold))
