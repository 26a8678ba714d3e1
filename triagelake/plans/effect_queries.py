"""Queries over effects, with their SQL.

The operators run over the events table seen as effects: the event type
stands for the effect type, the user for the sample, and the number in the
properties picks a target and a source.  The same operators run over real
scripts in the pipeline queries.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.functions import vocabulary as V
from triagelake.operators import effects as E
from triagelake.operators import graph as G
from triagelake.operators import passes as P2
from triagelake.operators import records as N
from triagelake.operators import recovery as V2
from triagelake.operators import rules as R
from triagelake.operators import scoring as S
from triagelake.operators import techniques as T
from triagelake.plans import pipeline
from triagelake.session import staged, table
from triagelake.sources import lisp

KINDS = {"click": "file_write", "view": "file_read", "purchase": "registry_modify", "error": "process_create", "signup": "com_create"}
TARGETS = (
    r"C:\cad\acad.lsp", "acaddoc.lsp", r"HKEY_CURRENT_USER\Software\Microsoft\Windows\CurrentVersion\Run", "cmd.exe /c del", "http://host.example/a?b=1", "WScript.Shell",
    "data.txt", "fn", "notes.bak", "tmp.dcl", "powershell -enc AA", "menu.mnu", "Msxml2.XMLHTTP", "ADODB.Stream", r"HKEY_LOCAL_MACHINE\Software\Hidden", "payload.exe",
)
SOURCES = ("open", "vl-file-copy", "write-line", "load", "vlax-invoke-method", "findfile", "vlr-reactor")


def event_effects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    pick = lambda values: F.array(*map(F.lit, values))
    return e.select(
        F.col("user_id").cast("string").alias("sample_id"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("fn"),
        F.coalesce(kind[F.col("event_type")], F.lit("network_connect")).alias("effect_type"), F.get(pick(TARGETS), k % len(TARGETS)).alias("target"),
        F.get(pick(SOURCES), k % len(SOURCES)).alias("source"), F.create_map().cast("map<string,string>").alias("meta"), F.lit(1).alias("line"),
    )


def effect_dedup(spark, sf_dir):
    return E.dedup_cap(event_effects(spark, sf_dir)).select("sample_id", "seq", "effect_type", "target", "source")


def effect_tags(spark, sf_dir):
    return E.tags(event_effects(spark, sf_dir))


def lift_first_match(spark, sf_dir):
    return E.lifted(event_effects(spark, sf_dir)).select("seq", "rule_id", "lifted_type", "severity", "lift_confidence")


def propagation(spark, sf_dir):
    return E.propagation(event_effects(spark, sf_dir))


def target_kinds(spark, sf_dir):
    t = E.targets(event_effects(spark, sf_dir))
    return t.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("samples"))


def effect_entropy(spark, sf_dir):
    return S.entropy(event_effects(spark, sf_dir)).select("sample_id", "total", "kinds", F.round("entropy", 6).alias("entropy"))


def feature_severity(spark, sf_dir):
    e = event_effects(spark, sf_dir)
    return e.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.effect_severity()), 6).alias("feature_evidence"))


def rule_hits(spark, sf_dir):
    return R.rule_hits(event_effects(spark, sf_dir))


def rule_evidence(spark, sf_dir):
    return S.rule_evidence(R.rule_hits(event_effects(spark, sf_dir))).select("sample_id", F.round("rule_evidence", 6).alias("rule_evidence"), "floor", "rules")


def technique_max(spark, sf_dir):
    o = T.effect_observations(event_effects(spark, sf_dir)).where("o is not null").select("sample_id", "o.*")
    return o.groupBy("sample_id", "technique").agg(F.max("confidence").alias("confidence"))


def technique_risk(spark, sf_dir):
    return T.technique_risk(technique_max(spark, sf_dir)).select("sample_id", F.round("attack_risk", 6).alias("attack_risk"))


# ------------------------------------------------------------------- graphs


def order_lines(spark, sf_dir):
    """Lines of an order as calls: the nation of a line's supplier calls the
    nation of the next line's; an order is a script of its own."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    s, n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return j.select(
        F.col("l_orderkey").cast("string").alias("sample_id"), F.col("n_name").alias("fn"), "n_nationkey", "n_regionkey", "l_returnflag", F.col("l_linenumber").alias("line"), F.lead("n_name").over(w).alias("next")
    )


def order_edges(spark, sf_dir):
    return order_lines(spark, sf_dir).where("fn <> next").select("sample_id", F.col("fn").alias("caller"), F.col("next").alias("callee")).distinct()


def order_effects(spark, sf_dir):
    k = F.col("n_nationkey")
    kinds = F.array_compact(F.array(F.when(k % 3 == 0, "file_write"), F.when(k % 4 == 0, "registry_modify"), F.when(k % 2 == 1, "file_read")))
    return order_lines(spark, sf_dir).select("sample_id", "fn", F.explode(kinds).alias("effect_type"))


def call_graph(spark, sf_dir):
    """Targets of calls that are made by name, by the name of an alias of the
    top level, or by one of the caller's own that stands for that alias."""
    rows = order_lines(spark, sf_dir)
    nxt = F.col("next")
    name = F.when(F.col("l_returnflag") == "A", nxt).when(F.col("l_returnflag") == "N", F.concat(F.lit("@"), nxt)).otherwise(F.concat(F.lit("@@"), nxt))
    calls = rows.where("next is not null").select("sample_id", "fn", name.alias("name"), "line")
    functions = rows.select("sample_id", "fn").distinct()
    top = functions.select("sample_id", F.lit("__toplevel__").alias("fn"), F.concat(F.lit("@"), "fn").alias("name"), F.col("fn").alias("target"))
    own = rows.where("l_returnflag not in ('A', 'N') and next is not null").select("sample_id", "fn", F.concat(F.lit("@@"), nxt).alias("name"), F.concat(F.lit("@"), nxt).alias("target"))
    return G.call_targets(calls, functions, top.unionByName(own.distinct()))


def reach_closure(spark, sf_dir):
    return G.closure(order_edges(spark, sf_dir))


def cycle_metrics(spark, sf_dir):
    e = staged(order_edges(spark, sf_dir))
    m = G.component_metrics(G.strong_components(e), e, order_effects(spark, sf_dir))
    return m.select("sample_id", "component", "size", F.size("entries").cast("bigint").alias("entries"), F.round("strength", 6).alias("strength"), F.array_join("effect_types", ",").alias("effect_types"))


def inherited_effects(spark, sf_dir):
    return E.all_effects(order_effects(spark, sf_dir), order_edges(spark, sf_dir))


def function_behaviours(spark, sf_dir):
    return E.behaviours(E.all_effects(order_effects(spark, sf_dir), order_edges(spark, sf_dir)))


def entry_spread(spark, sf_dir):
    """What each caller reaches."""
    e = staged(order_edges(spark, sf_dir))
    starts = e.select("sample_id", F.col("caller").alias("fn")).distinct()
    return G.spread(G.closure(e, starts), starts, order_effects(spark, sf_dir)).select("sample_id", "entry", "reached", "write_sinks", "max_depth", F.round("coverage", 6).alias("coverage"))


def effect_chains(spark, sf_dir):
    return G.chain_motifs(order_effects(spark, sf_dir), order_edges(spark, sf_dir))


def back_edges(spark, sf_dir):
    return G.back_edges(order_edges(spark, sf_dir))


def folded_definitions(spark, sf_dir):
    """Nations of an order that stay when those that others consume are
    folded away, but for those of one region."""
    from triagelake.operators.evaluation import folded

    name = lambda c: F.concat_ws(":", "sample_id", c)
    rows = order_lines(spark, sf_dir)
    uses = order_edges(spark, sf_dir).select(name("caller").alias("name"), name("callee").alias("dep"))
    return folded(rows.select(name("fn").alias("name")), uses, rows.where("n_regionkey = 1").select(name("fn").alias("name")))


# ----------------------------------------------------------------- pipeline


def script_effects(spark, sf_dir):
    f = pipeline.script_facts(table(spark, sf_dir, "samples"))
    return f.effects.select("sample_id", "seq", "fn", "effect_type", "target", "source", "line")


def script_calls(spark, sf_dir):
    f = pipeline.script_facts(table(spark, sf_dir, "samples"))
    return G.call_targets(f.calls, f.functions, f.aliases)


def script_rules(spark, sf_dir):
    f = pipeline.script_facts(table(spark, sf_dir, "samples"))
    return R.rule_hits(f.effects, R.top_nodes(f.nodes))


def script_techniques(spark, sf_dir):
    f = pipeline.script_facts(table(spark, sf_dir, "samples"))
    return T.techniques(f.effects, R.top_nodes(f.nodes), named_only=True)


def script_predicates(spark, sf_dir):
    return pipeline.formal(pipeline.script_facts(table(spark, sf_dir, "samples")))[0]


def script_motifs(spark, sf_dir):
    return pipeline.formal(pipeline.script_facts(table(spark, sf_dir, "samples")))[2]


def script_propagation(spark, sf_dir):
    return E.propagation(pipeline.script_facts(table(spark, sf_dir, "samples")).effects)


def script_context(spark, sf_dir):
    e = pipeline.script_facts(table(spark, sf_dir, "samples")).effects
    return S.context_score(e, E.tags(e), E.lifted(e))


def script_prompts(spark, sf_dir):
    f = pipeline.script_facts(table(spark, sf_dir, "samples"))
    return N.prompt_text(f.effects, G.call_targets(f.calls, f.functions, f.aliases))


def script_eval_rows(spark, sf_dir):
    """Rows of the batch report: one per sample, failures with their error."""
    samples = table(spark, sf_dir, "samples")
    failed = lisp.facts(pipeline.once(samples)).where("fact = 'error'").select("sample_id", F.col("name").alias("error"))
    rows = pipeline.scores(samples).join(failed, "sample_id", "left")
    verdict = F.when(F.col("error").isNotNull(), "ERROR").otherwise(F.col("verdict"))
    return rows.select(
        F.col("path").alias("sample"), "input_type", verdict.alias("verdict"), F.when(F.col("error").isNull(), F.col("risk")).otherwise(0.0).alias("risk"), F.lit(0.5).alias("threshold"), "techniques", "rule_count",
        F.lit(0.0).alias("attack_risk"), F.coalesce("error", F.lit("")).alias("error"),
    )


def script_bindings(spark, sf_dir):
    """Names bound at top level, per sample."""
    return V2.top_bindings(pipeline.script_facts(table(spark, sf_dir, "samples")).aliases).groupBy("sample_id").agg(F.count(F.lit(1)).alias("names"))


def script_apis(spark, sf_dir):
    """Interface names that scripts use, by the number of samples."""
    a = V2.candidate_apis(lisp.facts(pipeline.once(table(spark, sf_dir, "samples"))))
    return a.groupBy("api", V2.api_classes(F.col("api")).alias("class")).agg(F.count(F.lit(1)).alias("samples"))


def surface_mask(spark, sf_dir):
    """Events left when 30 % are dropped by digest, per type."""
    left = V2.mask_surface(table(spark, sf_dir, "events"), 0.3, 7, "event_id")
    return left.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def environment_classes(spark, sf_dir):
    r = table(spark, sf_dir, "fas_resources").where("kind = 'symbol' and value is not null").distinct()
    kind, severity = P2.environment_check(F.col("value"))
    level, what = P2.path_resolution(F.col("value"))
    return r.groupBy(kind.alias("kind"), severity.alias("severity"), level.alias("level"), what.alias("what")).agg(F.count(F.lit(1)).alias("n"))


def source_items(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("input_type = 'lsp'").select("sample_id", "text").distinct()
    return V2.source_items(s).groupBy("sample_id", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        effect_dedup, effect_tags, lift_first_match, propagation, target_kinds, effect_entropy, feature_severity, rule_hits, rule_evidence, technique_max, technique_risk,
        call_graph, reach_closure, cycle_metrics, inherited_effects, function_behaviours, entry_spread, effect_chains, back_edges, folded_definitions,
        script_effects, script_calls, script_rules, script_techniques, script_predicates, script_motifs, script_propagation, script_context, script_prompts,
        script_eval_rows, script_bindings, script_apis, surface_mask, environment_classes, source_items,
    )
}


def _case(column: str, table_: dict, rest: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE '{rest}' END"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_E = f"""ev AS (SELECT user_id::VARCHAR AS sample_id, event_id AS seq, 'f' || (k % 7) AS fn, {_case('event_type', KINDS, 'network_connect')} AS k_, {_list(TARGETS)}[k % {len(TARGETS)} + 1] AS target,
 {_list(SOURCES)}[k % {len(SOURCES)} + 1] AS source FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
e AS (SELECT *, k_ AS effect_type, lower(target) AS t, lower(source) AS s, lower(source) || ' ' || lower(target) AS x FROM ev)"""
_START = r"(contains(t, 'acad.lsp') OR contains(t, 'acaddoc.lsp') OR contains(t, 'acad.fas') OR contains(t, 'acad.vlx') OR contains(t, '.mnl') OR contains(t, 'startup'))"
_REG = has("t", *V.SUSPICIOUS_REGISTRY)
_PS = f"(contains(t, 'powershell') AND ({has('t', *V.POWERSHELL_RISKS)}))"
_CMD = f"({has('t', *V.SUSPICIOUS_COMMANDS)} OR {_PS})"
_PAYLOAD = f"({_START} OR (t NOT IN {tuple(V.NOISE_TARGETS)!r} AND NOT (length(t) <= 3 AND NOT {has('t', '.', chr(92), '/')}) AND ({has('t', *V.PAYLOAD_PATHS)} OR {has('t', *V.PAYLOAD_ENDINGS)})))".replace("'\\\\'", "'\\'").replace("':\\\\'", "':\\'")
_DROP = f"(effect_type = 'file_write' AND {_PAYLOAD} AND ({_START} OR {has('x', *V.PAYLOAD_ENDINGS, *V.SCRIPT_ENDINGS)}))"
_W, _RD, _COM, _NET, _PROC, _REGM = (f"effect_type = '{k}'" for k in ("file_write", "file_read", "com_create", "network_connect", "process_create", "registry_modify"))
_XML, _ADO, _SH = has("x", "xmlhttp", "msxml"), has("x", "adodb.stream", "adodb.connection"), has("x", "shell.application", "wscript.shell")
_B = lambda c, n: f"bool_or({c}) AS {n}"
_N = lambda c, n: f"count(CASE WHEN {c} THEN 1 END) AS {n}"
_FLAGS = "g AS (SELECT sample_id, " + ", ".join([
    _B(f"{_W} AND {_START}", "sw"), _B(has("s", "vl-file-copy"), "copies"), _B(f"({_W}) AND {has('t', 'acaddoc')}", "persist"), _B(f"({_COM}) AND {_XML}", "cx"), _B(f"({_COM}) AND {_ADO}", "ca"),
    _B(f"({_COM}) AND {_SH}", "cs"), _B(_NET, "net"), _B(f"({_NET}) AND {has('t', '?', '%')}", "shape"), _B(_DROP, "dropped"), _B(f"({_PROC}) AND {_CMD}", "ex"), _B(has("x", "acaddoc"), "doc"),
    _B(f"({_W} OR {_RD}) AND {has('s', 'vl-file-copy', 'vlax-invoke')}", "spreads"), _B(f"(({_W}) AND {has('s', 'app', 'copy', 'open', 'write')}) OR (({_RD}) AND {has('s', 'app', 'copy', 'read')})", "cf"),
    _B(f"({_PROC}) AND {has('t', 'erase', 'delete')}", "erase"), _B(f"({_W}) AND {has('t', '.bak', 'backup', 'ja', 'universidad')}", "backup"), _B(f"({_RD}) AND s = 'load' AND {_START}", "sl"),
    _B(has("t", "acadisa.lin", "base.dcl", "acad.lsp", "acaddoc"), "ia"), _B(f"({_RD}) AND {has('x', 'findfile')}", "rf"), _B(f"({_W}) AND {has('x', 'vl-file-copy')}", "wc"),
    _B(f"{_START} OR {has('x', 'acaddoc')}", "art"), _N(f"({_W}) AND {_START}", "nsw"), _N(_W, "nw"), _N(_RD, "nr"), _N(f"({_REGM}) AND {_REG}", "nreg"), _N(f"({_PROC}) AND {_CMD}", "nex"),
]) + " FROM e GROUP BY sample_id)"
_RULE_SQL = {
    "WORM_001": "(sw AND copies) OR nsw >= 2 OR (sw AND nr > 0 AND nw >= 2)",
    "NETWORK_001": "(cx AND net AND (dropped OR ex OR (cs AND shape))) OR (net AND (dropped OR ex OR (ca AND cs AND shape)))",
    "VBA_INJECT_001": "doc AND spreads",
    "WORM_REPL_001": "cf AND doc",
    "DESTRUCT_001": "backup OR erase",
    "STARTUP_LOAD_001": "sl",
    "NET_DROPPER_001": "net AND dropped",
    "PROC_EXEC_001": "ex",
    "COM_DROPPER_001": "((cx AND ca) OR (ca AND cs) OR (cx AND cs) OR (net AND ca)) AND (dropped OR ex) OR (cx AND ex)",
    "STARTUP_INFECT_001": "ia AND nr + nw >= 8",
    "FINDCOPY_001": "rf AND wc AND art",
}
_INFO = {r: (n, s) for r, n, s in V.RULES}
_HITS = f"WITH {_E}, {_FLAGS}, h AS (" + " UNION ALL ".join(
    [f"SELECT sample_id, '{r}' AS rule_id, '{_INFO[r][0]}' AS name, {_INFO[r][1]}::DOUBLE AS severity, 1::BIGINT AS hits FROM g WHERE {p}" for r, p in _RULE_SQL.items()]
    + [f"SELECT sample_id, '{r}', '{_INFO[r][0]}', {_INFO[r][1]}::DOUBLE, {n} FROM g WHERE {n} > 0" for r, n in (("REGISTRY_001", "nreg"), ("CMD_EXEC_001", "nex"))]
) + ")"
_SEVERITY = f"""CASE effect_type WHEN 'file_write' THEN CASE WHEN {has('t', 'tmp', 'temp', '.dcl')} OR {has('s', 'tmp', 'temp', '.dcl')} THEN 0.3 WHEN t IN ('fn', 'tmp', 'temp', 'f') THEN 0.0
 WHEN {_START.replace(" OR contains(t, '.mnl')", "")} OR contains(t, 'runonce') THEN 0.9 ELSE 0.6 END WHEN 'registry_modify' THEN CASE WHEN {_REG} THEN 0.9 ELSE 0.25 END
 WHEN 'process_create' THEN CASE WHEN {_CMD} THEN 0.9 ELSE 0.35 END WHEN 'network_connect' THEN 0.65
 WHEN 'com_create' THEN CASE WHEN {has('t', 'wscript', 'wscript.shell', 'shell.application', 'adodb.stream', 'adodb.connection', 'vbscript', 'scriptlet')} THEN 0.85 WHEN {has('t', 'xmlhttp', 'msxml')} THEN 0.55 WHEN contains(t, 'filesystemobject') THEN 0.25 ELSE 0.5 END
 WHEN 'file_read' THEN 0.3 ELSE 0.5 END"""
_APP = has("t", *V.BENIGN_APPLICATIONS)
_SF = f"(effect_type IN ('file_write', 'file_read') AND ({_START} OR contains(t, 'acaddoc')))"
_INT = has("t", "gettextstring", "insertionpoint", "effectivename", "addline", "addcircle", "addtext", "addmtext", "get", "put", "invoke")
_FOR = f"(effect_type = 'com_create' AND NOT {_INT})"
_KIND = f"CASE WHEN {has('t', 'wscript.shell', 'shell.application')} THEN 'shell' WHEN {has('t', 'xmlhttp', 'msxml')} THEN 'xmlhttp' WHEN contains(t, 'adodb') THEN 'adodb' WHEN {has('t', 'vbscript', 'scriptlet')} THEN 'script' WHEN contains(t, 'filesystemobject') THEN 'fso' WHEN contains(s, 'vlax-') AND {has('t', 'ent', 'obj')} THEN 'none' ELSE 'other' END"
_SHK = f"CASE WHEN {has('t', 'rundll32', 'setupapi')} THEN 'proxy' WHEN {has('t', 'cmd.exe', 'wscript')} THEN 'cmd' WHEN contains(t, 'powershell') THEN 'ps' WHEN {_APP} THEN 'app' ELSE 'os' END"
_TECH = [
    (_SF, "T1547.001", 0.95), (has("s", "vlr-"), "T1543", 0.88), (has("s", "vlr-"), "T1547.001", 0.82), (f"{_NET} AND NOT starts_with(t, 'http')", "T1071.001", 0.88), (f"{_NET} AND starts_with(t, 'http')", "T1071.001", 0.93),
    (f"{_RD} AND s = 'load'", "T1059.007", 0.30), (f"{_RD} AND s = 'load' AND {_START}", "T1059.007", 0.78), (f"{_RD} AND s = 'load' AND {_START}", "T1547.001", 0.72),
    (f"{_PROC} AND {_APP}", "T1059.007", 0.35), (f"{_PROC} AND NOT {_APP} AND {_CMD}", "T1059.007", 0.95), (f"{_PROC} AND NOT {_APP} AND NOT {_CMD}", "T1059.007", 0.40), (f"{_REGM} AND {_REG}", "T1112", 0.90),
    (f"{_FOR} AND {_KIND} = 'shell'", "T1059.003", 0.95), (f"{_FOR} AND {_KIND} = 'shell'", "T1106", 0.90), (f"{_FOR} AND {_KIND} = 'xmlhttp'", "T1071.001", 0.55), (f"{_FOR} AND {_KIND} = 'xmlhttp'", "T1106", 0.55),
    (f"{_FOR} AND {_KIND} = 'adodb'", "T1105", 0.90), (f"{_FOR} AND {_KIND} = 'other'", "T1106", 0.50), (f"{_PROC} AND {_SHK} = 'cmd'", "T1059.003", 0.92), (f"{_PROC} AND {_SHK} = 'ps'", "T1059.003", 0.90),
    (f"{_PROC} AND {_SHK} = 'app'", "T1059.003", 0.30), (f"{_PROC} AND {_SHK} = 'os'", "T1059.003", 0.80),
]
_TMAX = f"WITH {_E}, o AS (" + " UNION ALL ".join(f"SELECT sample_id, '{t}' AS technique, {c}::DOUBLE AS confidence FROM e WHERE {p}" for p, t, c in _TECH) + "), m AS (SELECT sample_id, technique, max(confidence) AS confidence FROM o GROUP BY ALL)"
_WEIGHT = "CASE technique " + " ".join(f"WHEN '{t}' THEN {w}::DOUBLE" for t, _, w in V.TECHNIQUES) + " ELSE 0.5::DOUBLE END"
_TAGS = "CASE effect_type " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in V.TAGS.items()) + " END"
_EDGES = """ol AS (SELECT l_orderkey::VARCHAR AS sample_id, n_name AS fn, n_nationkey, n_regionkey, lead(n_name) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey), ed AS (SELECT DISTINCT sample_id, fn AS caller, nxt AS callee FROM ol WHERE fn <> nxt)"""
_REACH = """rc(sample_id, src, dst, depth) AS (SELECT sample_id, caller, callee, 1 FROM ed UNION SELECT r.sample_id, r.src, x.callee, r.depth + 1 FROM rc r JOIN ed x ON x.sample_id = r.sample_id AND x.caller = r.dst WHERE r.depth < 26),
cl AS (SELECT sample_id, src, dst, min(depth) AS depth FROM rc GROUP BY ALL)"""
_NE = """ne AS (SELECT sample_id, fn, k AS effect_type FROM (SELECT *, unnest(list_filter([CASE WHEN n_nationkey % 3 = 0 THEN 'file_write' END, CASE WHEN n_nationkey % 4 = 0 THEN 'registry_modify' END,
 CASE WHEN n_nationkey % 2 = 1 THEN 'file_read' END], lambda x: x IS NOT NULL)) AS k FROM ol))"""
_SCC = "sc AS (SELECT a.sample_id, a.src AS fn, least(min(a.dst), a.src) AS component FROM cl a JOIN cl b ON a.sample_id = b.sample_id AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.sample_id, a.src)"
_ALL = """al AS (SELECT coalesce(o.sample_id, i.sample_id) AS sample_id, coalesce(o.fn, i.fn) AS fn, coalesce(o.effect_type, i.effect_type) AS effect_type, coalesce(o.n, 1) AS n, o.fn IS NOT NULL AS own FROM
 (SELECT sample_id, fn, effect_type, count(*) AS n FROM ne GROUP BY ALL) o FULL JOIN (SELECT DISTINCT cl.sample_id, src AS fn, effect_type FROM cl JOIN ne ON ne.sample_id = cl.sample_id AND ne.fn = cl.dst) i
 ON o.sample_id = i.sample_id AND o.fn = i.fn AND o.effect_type = i.effect_type)"""

SQL = {
    "effect_dedup": f"""WITH {_E}, d AS (SELECT sample_id, min(seq) AS seq, effect_type, target, source FROM e GROUP BY sample_id, effect_type, target, source)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY seq) <= 1000""",
    "effect_tags": f"WITH {_E} SELECT DISTINCT sample_id, effect_type || ':' || target AS effect_key, unnest({_TAGS}) AS tag FROM e",
    "lift_first_match": f"""WITH {_E} SELECT seq, r AS rule_id, CASE r WHEN 'PERSIST_001' THEN 'PERSISTENCE' WHEN 'PERSIST_002' THEN 'PERSISTENCE' WHEN 'STEALTH_002' THEN 'STEALTH' WHEN 'TEMP_FILE_WRITE' THEN 'TEMP_FILE_WRITE' WHEN 'BASIC_FILE_WRITE' THEN 'FILE_WRITE'
 WHEN 'BASIC_REGISTRY_WRITE' THEN 'REGISTRY_MOD' WHEN 'BASIC_PROCESS_CREATE' THEN 'PROCESS_EXEC' WHEN 'BASIC_COM_CREATE' THEN 'COM_CREATE' WHEN 'BASIC_NETWORK_CONNECT' THEN 'NETWORK_HTTP' ELSE upper(effect_type) END AS lifted_type,
 CASE r WHEN 'TEMP_FILE_WRITE' THEN 'low' WHEN 'BASIC_FILE_WRITE' THEN 'medium' WHEN 'BASIC_COM_CREATE' THEN 'medium' WHEN 'DEFAULT' THEN 'medium' ELSE 'high' END AS severity,
 (CASE r WHEN 'PERSIST_001' THEN 0.9 WHEN 'PERSIST_002' THEN 0.9 WHEN 'STEALTH_002' THEN 0.85 WHEN 'TEMP_FILE_WRITE' THEN 0.3 WHEN 'BASIC_FILE_WRITE' THEN 0.7 WHEN 'BASIC_REGISTRY_WRITE' THEN 0.8 WHEN 'BASIC_PROCESS_CREATE' THEN 0.85
 WHEN 'BASIC_COM_CREATE' THEN 0.7 WHEN 'BASIC_NETWORK_CONNECT' THEN 0.8 ELSE 0.6 END)::DOUBLE AS lift_confidence FROM (
 SELECT *, CASE WHEN effect_type = 'file_write' AND regexp_matches(target, '(acad|acaddoc)\\.lsp$') THEN 'PERSIST_001' WHEN effect_type = 'registry_modify' AND regexp_matches(target, '\\\\Run') THEN 'PERSIST_002'
 WHEN effect_type = 'registry_modify' AND regexp_matches(target, 'Hidden|ShowAll') THEN 'STEALTH_002' WHEN effect_type = 'file_write' AND contains(target, 'fn') THEN 'TEMP_FILE_WRITE' WHEN effect_type = 'file_write' THEN 'BASIC_FILE_WRITE'
 WHEN effect_type = 'registry_modify' THEN 'BASIC_REGISTRY_WRITE' WHEN effect_type = 'process_create' THEN 'BASIC_PROCESS_CREATE' WHEN effect_type = 'com_create' THEN 'BASIC_COM_CREATE' WHEN effect_type = 'network_connect' THEN 'BASIC_NETWORK_CONNECT' ELSE 'DEFAULT' END AS r FROM e)""",
    "propagation": f"""WITH {_E}, a AS (SELECT sample_id, count(*) AS targets, {_N(_W, 'complexity')}, count(DISTINCT CASE WHEN {_W} THEN target END) AS write_paths, count(DISTINCT CASE WHEN {_RD} THEN target END) AS source_paths, count(DISTINCT fn) AS methods,
 {_B(f"({_W}) AND {has('t', 'acad.lsp', 'acaddoc.lsp', 'startup', '.mnl')}", 'sw')}, {_B(has('t', 'acad.lsp', 'acaddoc.lsp', 'startup', '.mnl'), 'st')}, {_B(has('t', 'load', 'require'), 'au')}, {_B(_NET, 'net')}, {_B(has('t', chr(92) * 2, '//', 'network', 'share'), 'lat')} FROM e GROUP BY sample_id)
SELECT sample_id, targets, complexity, write_paths, source_paths, methods, w AS is_worm, CASE WHEN NOT w THEN 'none' WHEN complexity >= 5 THEN 'high' WHEN complexity >= 3 THEN 'medium' WHEN complexity >= 1 THEN 'low' ELSE 'none' END AS replication,
 lat AS lateral_movement, st OR au AS local_autoload, w OR lat OR (st AND au) AS propagation_likely FROM (SELECT *, write_paths >= 2 AND (sw OR net) AS w FROM a)""",
    "target_kinds": f"""WITH {_E} SELECT CASE WHEN {has('t', 'acad.lsp', 'acaddoc.lsp', 'startup', '.mnl')} THEN 'startup' WHEN {has('t', 'menu', '.mnu')} THEN 'menu' WHEN regexp_matches(t, '\\.(lsp|fas|vlx|scr)$') THEN 'code' WHEN contains(t, 'registry') THEN 'registry'
 WHEN {has('t', 'config', '.ini')} OR t LIKE '%.cfg' THEN 'config' WHEN regexp_matches(t, '\\.(exe|dll|bat|cmd)$') THEN 'executable' ELSE 'other' END AS kind,
 CASE WHEN effect_type IN ('file_write', 'registry_modify') THEN 'high' WHEN effect_type = 'file_read' THEN 'medium' WHEN effect_type = 'process_create' THEN 'critical' ELSE 'low' END AS severity, count(*) AS n, count(DISTINCT sample_id) AS samples FROM e GROUP BY ALL""",
    "effect_entropy": f"""WITH {_E}, n AS (SELECT sample_id, effect_type, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT sample_id, sum(n)::BIGINT AS total, count(*) AS kinds, sum(n * log2(n)) AS x FROM n GROUP BY sample_id)
SELECT sample_id, total, kinds, round(CASE WHEN kinds > 1 THEN (log2(total) - x / total) / log2(kinds) ELSE 0 END, 6) AS entropy FROM p""",
    "feature_severity": f"WITH {_E} SELECT sample_id, count(*) AS n, round(avg(({_SEVERITY})::DOUBLE), 6) AS feature_evidence FROM e GROUP BY sample_id",
    "rule_hits": f"{_HITS} SELECT * FROM h",
    "rule_evidence": f"{_HITS} SELECT sample_id, round(sum(severity * hits) / sum(hits), 6) AS rule_evidence, max((CASE rule_id {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in V.RISK_FLOORS.items())} ELSE 0.0 END)::DOUBLE) AS floor, sum(hits)::BIGINT AS rules FROM h GROUP BY sample_id",
    "technique_max": f"{_TMAX} SELECT * FROM m",
    "technique_risk": f"{_TMAX} SELECT sample_id, round(least(sum({_WEIGHT} * confidence) / sum({_WEIGHT}), 1.0), 6) AS attack_risk FROM m GROUP BY sample_id",
    "call_graph": f"WITH {_EDGES} SELECT DISTINCT sample_id, fn AS caller, nxt AS callee FROM ol WHERE nxt IS NOT NULL",
    "reach_closure": f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT * FROM cl",
    "cycle_metrics": f"""WITH RECURSIVE {_EDGES}, {_REACH}, {_NE}, {_SCC}, m AS (SELECT ed.*, p.component AS pc, q.component AS qc FROM ed LEFT JOIN sc p ON p.sample_id = ed.sample_id AND p.fn = caller LEFT JOIN sc q ON q.sample_id = ed.sample_id AND q.fn = callee)
SELECT s.sample_id, s.component, count(*) AS size, (SELECT count(DISTINCT callee) FROM m WHERE m.sample_id = s.sample_id AND m.qc = s.component AND (m.pc IS NULL OR m.pc <> m.qc)) AS entries,
 round((SELECT count(*) FROM m WHERE m.sample_id = s.sample_id AND m.pc = s.component AND m.qc = s.component) / (count(*) * (count(*) - 1)), 6) AS strength,
 coalesce((SELECT string_agg(DISTINCT effect_type, ',' ORDER BY effect_type) FROM ne JOIN sc z ON z.sample_id = ne.sample_id AND z.fn = ne.fn WHERE z.sample_id = s.sample_id AND z.component = s.component), '') AS effect_types FROM sc s GROUP BY s.sample_id, s.component""",
    "inherited_effects": f"WITH RECURSIVE {_EDGES}, {_REACH}, {_NE}, {_ALL} SELECT * FROM al",
    "function_behaviours": f"""WITH RECURSIVE {_EDGES}, {_REACH}, {_NE}, {_ALL} SELECT sample_id, fn, 'stealth_persistence' AS behaviour FROM al WHERE effect_type IN ('file_write', 'registry_modify') GROUP BY sample_id, fn HAVING count(DISTINCT effect_type) = 2""",
    "entry_spread": f"""WITH RECURSIVE {_EDGES}, {_REACH}, {_NE}, st AS (SELECT DISTINCT sample_id, caller AS entry FROM ed),
p AS (SELECT sample_id, entry, fn, min(depth) AS depth FROM (SELECT sample_id, entry, entry AS fn, 0 AS depth FROM st UNION ALL SELECT st.sample_id, entry, dst, depth FROM st JOIN cl ON cl.sample_id = st.sample_id AND src = entry) GROUP BY ALL),
w AS (SELECT DISTINCT sample_id, fn FROM ne WHERE effect_type = 'file_write')
SELECT sample_id, entry, count(*) AS reached, count(wf) AS write_sinks, max(depth) AS max_depth, round(coalesce(count(wf) / nullif(max(tw), 0), 0), 6) AS coverage FROM (
 SELECT p.*, w.fn AS wf, (SELECT count(*) FROM w x WHERE x.sample_id = p.sample_id) AS tw FROM p LEFT JOIN w ON w.sample_id = p.sample_id AND w.fn = p.fn) GROUP BY sample_id, entry""",
    "effect_chains": f"""WITH {_EDGES}, {_NE}, k AS (SELECT sample_id, fn FROM ne GROUP BY ALL HAVING count(DISTINCT effect_type) >= 2 AND bool_or(effect_type = 'file_write'))
SELECT k.sample_id, 'effect_chain' AS motif, fn AS anchor, round(least(0.4 + 0.1 * (count(DISTINCT caller) - 1), 0.7)::DOUBLE, 6) AS confidence FROM k JOIN ed ON ed.sample_id = k.sample_id AND callee = fn GROUP BY ALL""",
    "surface_mask": "SELECT event_type, count(*) AS n FROM events WHERE ('0x' || left(md5('7|' || event_id), 8))::BIGINT >= floor(0.3::DOUBLE * 4294967296) GROUP BY 1",
    "environment_classes": r"""SELECT CASE WHEN regexp_matches(t, 'date|time') THEN 'TIME' WHEN regexp_matches(t, 'mac|host|serial') THEN 'HOST_ID' WHEN regexp_matches(t, 'dwg|file|path') THEN 'FILE_CONTEXT' WHEN regexp_matches(t, 'acad|product|ver') THEN 'APP_CONTEXT' ELSE 'SYSTEM_CONTEXT' END AS kind,
 CASE WHEN regexp_matches(t, 'date|time|mac|host|serial') THEN 'high' WHEN regexp_matches(t, 'dwg|file|path') THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN value IN ('', 'unknown') THEN 'unresolved' WHEN regexp_matches(value, '^([A-Za-z]:[\\/]|[\\/]{2}|/)') THEN 'full' WHEN regexp_matches(value, '[\\/.]') THEN 'partial' ELSE 'unresolved' END AS level,
 CASE WHEN regexp_matches(t, 'acad\.lsp|acaddoc\.lsp|startup|\.mnl') THEN 'startup' WHEN regexp_matches(t, 'menu|\.mnu|\.cui') THEN 'menu' ELSE 'data' END AS what, count(*) AS n
FROM (SELECT DISTINCT *, lower(value) AS t FROM fas_resources WHERE kind = 'symbol' AND value IS NOT NULL) GROUP BY ALL""",
    "folded_definitions": f"""WITH {_EDGES}, d AS (SELECT sample_id || ':' || fn AS name, bool_or(n_regionkey = 1) AS x FROM ol GROUP BY ALL)
SELECT name FROM d WHERE x OR name NOT IN (SELECT sample_id || ':' || callee FROM ed)""",
}
