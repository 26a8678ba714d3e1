"""Graph operators over edge tables: reachability, cycles, predicates, motifs.

Edges are keyed by sample, so one run of an operator serves all samples.
Reachability is a loop of joins against the frontier that keeps only new
pairs, with the lineage cut each round; it starts from the functions asked
for.  Cycles need no pairs: a small graph is walked in one pass, a large one
is coloured over its edges.
"""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import staged


def call_targets(calls: DataFrame, functions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges ``(sample_id, caller, callee)`` to known functions, directly or
    through the aliases that the caller and the top level assign."""
    called = calls.select("sample_id", F.col("fn").alias("caller"), F.col("name").alias("symbol")).where("symbol <> ''").distinct()
    known = functions.select("sample_id", F.col("fn").alias("callee")).distinct()
    # both may come from one table of facts, so the key has a name of its own
    target = known.withColumnRenamed("sample_id", "_k")
    hit = called.join(target, (F.col("sample_id") == F.col("_k")) & (F.col("symbol") == F.col("callee")), "left").drop("_k")
    found = hit.where("callee is not null").select("sample_id", "caller", "callee")
    # scope of an alias: its own function; the top level's serve every caller
    own = aliases.select("sample_id", F.col("fn").alias("caller"), F.col("name").alias("symbol"), F.col("target").alias("next"))
    top = own.where("caller = '__toplevel__'").drop("caller").join(known.select("sample_id", F.col("callee").alias("caller")), "sample_id")
    steps = staged(own.unionByName(top.select("sample_id", "caller", "symbol", "next")).where("next <> '' and symbol <> next").distinct())
    frontier = staged(hit.where("callee is null").select("sample_id", "caller", "symbol"))
    seen = frontier
    for rounds in count(1):  # ends, as only new symbols go on
        moved = frontier.join(steps, ["sample_id", "caller", "symbol"]).select("sample_id", "caller", F.col("next").alias("symbol")).distinct()
        moved = staged(moved.join(seen, ["sample_id", "caller", "symbol"], "left_anti"))
        if moved.isEmpty():
            break
        k = known.withColumnRenamed("callee", "symbol")
        found = staged(found.unionByName(moved.join(k, ["sample_id", "symbol"], "left_semi").select("sample_id", "caller", F.col("symbol").alias("callee"))).distinct())
        seen = seen.unionByName(moved)
        if rounds % 8 == 0:
            seen = staged(seen)
        frontier = moved.join(k, ["sample_id", "symbol"], "left_anti")
    return found.distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("sample_id", F.col("callee").alias("caller"), F.col("caller").alias("callee"))


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``(sample_id, src, dst, depth)`` of all pairs joined by a path of one
    edge or more; depth is that of a shortest path.  With ``starts(sample_id,
    fn)`` only paths from these."""
    e = staged(edges.select("sample_id", "caller", "callee").distinct())
    step = e.select("sample_id", F.col("caller").alias("dst"), F.col("callee").alias("next"))
    frontier = e.select("sample_id", F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit(1).alias("depth"))
    if starts is not None:
        frontier = staged(frontier.join(starts.select("sample_id", F.col("fn").alias("src")).distinct(), ["sample_id", "src"], "left_semi"))
    reached = frontier
    for depth in count(2):  # ends, as only new pairs go on
        new = frontier.join(step, ["sample_id", "dst"]).select("sample_id", "src", F.col("next").alias("dst")).distinct()
        new = staged(new.join(reached.select("sample_id", "src", "dst"), ["sample_id", "src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        frontier = new.drop("depth")
        if depth % 8 == 0:
            reached = staged(reached)
    return reached


# edges of a sample that are walked in one pass
WALKED = 100_000


def _per_graph(edges: DataFrame, walk, columns: str) -> DataFrame:
    """``walk(pairs)`` of each sample's graph, graph after graph: a batch
    holds many small ones, which one call a graph would be slow for."""
    names = ["sample_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(it):
        at, pairs = None, []
        for pdf in it:
            out = []
            for sample, a, b in zip(pdf["sample_id"], pdf["caller"], pdf["callee"]):
                if sample != at:
                    out += [(at, *r) for r in walk(pairs)]
                    at, pairs = sample, []
                pairs.append((a, b))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(at, *r) for r in walk(pairs)], columns=names)

    by_graph = edges.select("sample_id", "caller", "callee").distinct().repartition("sample_id").sortWithinPartitions("sample_id", "caller", "callee")
    return by_graph.mapInPandas(run, "sample_id string, " + columns)


def _cycles(pairs: list) -> list:
    """(function, component) of components of two or more of one graph: a walk
    that keeps the lowest number seen below each function."""
    out_of: dict[str, list] = {}
    for a, b in pairs:
        out_of.setdefault(a, []).append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    found = []

    def enter(fn):
        number[fn] = low[fn] = len(number)
        held.append(fn)
        inside.add(fn)
        return fn, iter(out_of.get(fn, ()))

    for root in out_of:
        if root in number:
            continue
        work = [enter(root)]
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in number:
                    work.append(enter(b))
                    break
                if b in inside:
                    low[node] = min(low[node], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(held.pop())
                    inside.difference_update(group)
                    if len(group) > 1:
                        least = min(group)
                        found += [(fn, least) for fn in group]
    return found


def strong_components(edges: DataFrame, walked: int = WALKED) -> DataFrame:
    """``(sample_id, fn, component)`` of functions on a cycle of two or more;
    the component is its least name.

    Samples with at most ``walked`` edges are walked, one a group; the graphs
    of larger ones are coloured by joins over their edges.
    """
    e = edges.select("sample_id", "caller", "callee").where("caller <> callee").distinct()
    e = staged(e)
    large = e.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > walked).select("sample_id")
    if large.isEmpty():
        return _per_graph(e, _cycles, "fn string, component string")
    large = staged(large)
    found = _per_graph(e.join(large, "sample_id", "left_anti"), _cycles, "fn string, component string")
    return found.unionByName(_coloured(staged(e.join(large, "sample_id", "left_semi"))))


def _spread_least(edges: DataFrame, own: DataFrame) -> DataFrame:
    """The least colour that reaches each function, along the edges."""
    step = edges.select("sample_id", F.col("caller").alias("fn"), F.col("callee").alias("next"))
    colour, moved = own, own
    while True:
        better = moved.join(step, ["sample_id", "fn"]).groupBy("sample_id", F.col("next").alias("fn")).agg(F.min("colour").alias("colour"))
        moved = staged(better.join(colour.withColumnRenamed("colour", "was"), ["sample_id", "fn"]).where("colour < was").drop("was"))
        if moved.isEmpty():
            return colour
        colour = staged(colour.unionByName(moved).groupBy("sample_id", "fn").agg(F.min("colour").alias("colour")))


def _coloured(left: DataFrame) -> DataFrame:
    """Cycles by colouring: each function takes the least name that reaches
    it; those of a colour that reach its owner backwards are a component."""
    found = None
    while True:
        while True:  # drop what has no call in, or none out
            ins, outs = left.select("sample_id", F.col("callee").alias("caller")).distinct(), left.select("sample_id", F.col("caller").alias("callee")).distinct()
            kept = staged(left.join(ins, ["sample_id", "caller"], "left_semi").join(outs, ["sample_id", "callee"], "left_semi"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            return found if found is not None else left.select("sample_id", F.col("caller").alias("fn"), F.col("callee").alias("component"))
        names = left.select("sample_id", F.explode(F.array("caller", "callee")).alias("fn")).distinct()
        colour = staged(_spread_least(left, staged(names.withColumn("colour", F.col("fn")))))
        a, b = colour.select("sample_id", F.col("fn").alias("caller"), F.col("colour").alias("ca")), colour.select("sample_id", F.col("fn").alias("callee"), F.col("colour").alias("cb"))
        inner = staged(left.join(a, ["sample_id", "caller"]).join(b, ["sample_id", "callee"]).where("ca = cb"))
        back = inner.select("sample_id", F.col("callee").alias("fn"), F.col("caller").alias("next"))
        part = moved = staged(colour.where("fn = colour"))
        while True:
            new = moved.join(back, ["sample_id", "fn"]).select("sample_id", F.col("next").alias("fn"), "colour").distinct()
            moved = staged(new.join(part, ["sample_id", "fn"], "left_anti"))
            if moved.isEmpty():
                break
            part = staged(part.unionByName(moved))
        group = Window.partitionBy("sample_id", "colour")
        cycles = part.withColumn("n", F.count(F.lit(1)).over(group)).where("n > 1").select("sample_id", "fn", F.col("colour").alias("component"))
        found = staged(cycles if found is None else found.unionByName(cycles))
        gone = part.select("sample_id", F.col("fn").alias("caller"))
        left = staged(left.join(gone, ["sample_id", "caller"], "left_anti").join(gone.withColumnRenamed("caller", "callee"), ["sample_id", "callee"], "left_anti"))


def component_metrics(components: DataFrame, edges: DataFrame, effects: DataFrame | None = None) -> DataFrame:
    """Size, entries (called from outside), strength and effects of cycles."""
    a = components.select("sample_id", F.col("fn").alias("caller"), F.col("component").alias("from_c"))
    b = components.select("sample_id", F.col("fn").alias("callee"), F.col("component").alias("to_c"))
    marked = edges.select("sample_id", "caller", "callee").distinct().join(a, ["sample_id", "caller"], "left").join(b, ["sample_id", "callee"], "left")
    inside = marked.where("from_c = to_c").groupBy("sample_id", F.col("to_c").alias("component")).agg(F.count(F.lit(1)).alias("inner_edges"))
    entry = marked.where("to_c is not null and (from_c is null or from_c <> to_c)").groupBy("sample_id", F.col("to_c").alias("component")).agg(
        F.array_sort(F.collect_set("callee")).alias("entries")
    )
    size = components.groupBy("sample_id", "component").agg(F.count(F.lit(1)).alias("size"))
    out = size.join(inside, ["sample_id", "component"], "left").join(entry, ["sample_id", "component"], "left")
    out = out.withColumn("strength", F.coalesce("inner_edges", F.lit(0)) / (F.col("size") * (F.col("size") - 1)))
    out = out.withColumn("entries", F.coalesce("entries", F.array().cast("array<string>")))
    if effects is not None:
        kinds = components.join(effects.select("sample_id", "fn", "effect_type").distinct(), ["sample_id", "fn"])
        kinds = kinds.groupBy("sample_id", "component").agg(F.array_sort(F.collect_set("effect_type")).alias("effect_types"))
        out = out.join(kinds, ["sample_id", "component"], "left").withColumn("effect_types", F.coalesce("effect_types", F.array().cast("array<string>")))
    return out.drop("inner_edges")


def _open_again(pairs: list) -> list:
    out_of: dict[str, list] = {}
    for a, b in sorted(pairs):
        out_of.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    found = []
    for root in sorted({x for p in pairs for x in p}):
        if root in state:
            continue
        state[root] = 1
        stack = [(root, iter(out_of.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            for b in rest:
                if state.get(b) == 1:
                    found.append((node, b))
                elif b not in state:
                    state[b] = 1
                    stack.append((b, iter(out_of.get(b, ()))))
                    break
            else:
                state[node] = 2
                stack.pop()
    return found


def back_edges(edges: DataFrame) -> DataFrame:
    """Edges to a function that is still open in a depth-first walk that takes
    names in order; one sample's graph, which is that of one script, is held
    at a time."""
    return _per_graph(edges, _open_again, "caller string, callee string")


def spread(reach: DataFrame, entries: DataFrame, effects: DataFrame) -> DataFrame:
    """What each entry point reaches: functions, writers, coverage, depth.

    The entry counts itself.  Coverage is the share of all writing functions
    of the sample; the depth is that of the farthest shortest path.
    """
    start = entries.select("sample_id", F.col("fn").alias("entry")).distinct()
    own = start.select("sample_id", "entry", F.col("entry").alias("fn"), F.lit(0).alias("depth"))
    far = start.join(reach.select("sample_id", F.col("src").alias("entry"), F.col("dst").alias("fn"), "depth"), ["sample_id", "entry"])
    pairs = own.unionByName(far.select("sample_id", "entry", "fn", "depth")).groupBy("sample_id", "entry", "fn").agg(F.min("depth").alias("depth"))
    writers = effects.where("effect_type = 'file_write'").select("sample_id", "fn").distinct().withColumn("w", F.lit(1))
    total = writers.groupBy("sample_id").agg(F.count(F.lit(1)).alias("writers"))
    agg = pairs.join(writers, ["sample_id", "fn"], "left").groupBy("sample_id", "entry").agg(
        F.count(F.lit(1)).alias("reached"), F.sum(F.coalesce("w", F.lit(0))).alias("write_sinks"), F.max("depth").alias("max_depth")
    )
    return agg.join(total, "sample_id", "left").select(
        "sample_id", "entry", "reached", "write_sinks", "max_depth",
        F.coalesce(F.try_divide(F.col("write_sinks"), F.col("writers")), F.lit(0.0)).alias("coverage"),
    )


def worm_predicate(metrics: DataFrame) -> DataFrame:
    """Cycle that writes files and starts by itself, per sample: the strongest
    candidate with an entry, else the first."""
    candidates = metrics.where(F.array_contains("effect_types", "file_write"))
    has_entry = F.size("entries") > 0
    order = Window.partitionBy("sample_id").orderBy(has_entry.desc(), F.when(has_entry, F.col("strength")).desc_nulls_last(), "component")
    best = candidates.withColumn("_k", F.row_number().over(order)).where("_k = 1")
    startup = F.exists("entries", lambda e: F.lower(e).startswith("s::"))
    strong = F.col("strength") > 0.5
    conf = F.lit(0.4) + F.when(startup, 0.3).otherwise(0.0) + F.when(strong, 0.15).otherwise(0.0) + F.when(has_entry, 0.15).otherwise(0.0)
    return best.select("sample_id", F.lit("worm").alias("predicate"), (startup & strong).alias("satisfied"), F.round(conf, 6).alias("confidence"))


def stealth_predicate(effects: DataFrame) -> DataFrame:
    """A function that writes files and the registry and checks nothing."""
    flags = effects.groupBy("sample_id", "fn").agg(
        F.bool_or(F.col("effect_type") == "file_write").alias("w"),
        F.bool_or(F.col("effect_type") == "registry_modify").alias("r"),
        F.bool_or(F.col("effect_type") == "env_check").alias("e"),
    )
    per = flags.groupBy("sample_id").agg(F.bool_or(F.col("w") & F.col("r") & ~F.col("e")).alias("satisfied"))
    return per.select("sample_id", F.lit("stealth_persistence").alias("predicate"), "satisfied", F.when(F.col("satisfied"), 0.85).otherwise(0.0).alias("confidence"))


def spread_predicate(spreads: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The entry with the best coverage reaches enough writers, or deep."""
    best = spreads.groupBy("sample_id").agg(F.max_by(F.struct("coverage", "max_depth", "reached"), F.struct("coverage", "entry")).alias("b")).select("sample_id", "b.*")
    conf = F.least(
        F.lit(0.5) * F.col("coverage") / threshold
        + F.lit(0.3) * F.least(F.col("max_depth") / 5, F.lit(1.0))
        + F.lit(0.2) * F.least(F.col("reached") / 10, F.lit(1.0)),
        F.lit(1.0),
    )
    return best.select(
        "sample_id", F.lit("propagation_closure").alias("predicate"), ((F.col("coverage") > threshold) | (F.col("max_depth") > 2)).alias("satisfied"), F.round(conf, 6).alias("confidence")
    )


def cycle_motifs(metrics: DataFrame, backs: DataFrame | None = None) -> DataFrame:
    """Cycles, and loops that an entry starts and that write files."""
    cycle = metrics.select("sample_id", F.lit("cycle").alias("motif"), F.col("component").alias("anchor"), F.round("strength", 6).alias("confidence"))
    n = F.lit(0) if backs is None else F.coalesce("backs", F.lit(0))
    m = metrics if backs is None else metrics.join(backs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("backs")), "sample_id", "left")
    loops = m.where(F.array_contains("effect_types", "file_write") & (F.size("entries") > 0)) if "effect_types" in m.columns else m.where("false")
    conf = F.least(F.lit(0.5) * F.col("strength") + F.lit(0.3) * n / F.col("size") + F.lit(0.2), F.lit(1.0))
    return cycle.unionByName(loops.select("sample_id", F.lit("persistence_loop").alias("motif"), F.col("component").alias("anchor"), F.round(conf, 6).alias("confidence")))


def chain_motifs(effects: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with two effects or more, file writes among them, by callers."""
    kinds = effects.groupBy("sample_id", "fn").agg(F.count_distinct("effect_type").alias("kinds"), F.bool_or(F.col("effect_type") == "file_write").alias("w")).where("w and kinds >= 2")
    callers = edges.groupBy("sample_id", F.col("callee").alias("fn")).agg(F.count_distinct("caller").alias("callers"))
    conf = F.least(F.lit(0.4) + F.lit(0.1) * (F.coalesce("callers", F.lit(0)) - 1), F.lit(0.7))
    return kinds.join(callers, ["sample_id", "fn"], "left").where("callers >= 1").select(
        "sample_id", F.lit("effect_chain").alias("motif"), F.col("fn").alias("anchor"), F.round(conf, 6).alias("confidence")
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes(sample_id, fn)``."""
    n = nodes.select("sample_id", "fn").distinct()
    out = edges.join(n.withColumnRenamed("fn", "caller"), ["sample_id", "caller"], "left_semi")
    return out.join(n.withColumnRenamed("fn", "callee"), ["sample_id", "callee"], "left_semi")


def sequence_edges(nodes: DataFrame) -> DataFrame:
    """Edges from each call of a function's body to the next, by order."""
    w = Window.partitionBy("sample_id", "parent").orderBy("seq")
    return nodes.where("depth = 1").withColumn("next", F.lead("seq").over(w)).where("next is not null").select("sample_id", F.col("seq").alias("src"), F.col("next").alias("dst"))


def reachable_blocks(entries: DataFrame, successors: DataFrame) -> DataFrame:
    """Blocks that control flow reaches; the others are dead code.

    ``entries(sample_id, block)``, ``successors(sample_id, src, dst)``.
    """
    reach = closure(successors.select("sample_id", F.col("src").alias("caller"), F.col("dst").alias("callee")), entries.select("sample_id", F.col("block").alias("fn")))
    far = entries.join(reach.withColumnRenamed("src", "block"), ["sample_id", "block"]).select("sample_id", F.col("dst").alias("block"))
    return entries.select("sample_id", "block").unionByName(far).distinct()
