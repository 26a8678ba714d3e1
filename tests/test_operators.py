import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagelake.functions import text as X
from triagelake.operators import components as C
from triagelake.operators import effects as E
from triagelake.operators import evaluation as A
from triagelake.operators import graph as G
from triagelake.operators import records as N
from triagelake.operators import rules as R
from triagelake.operators import scoring as S
from triagelake.operators import techniques as T
from triagelake.plans import pipeline
from triagelake.sources import lisp

EFFECT = "sample_id string, seq int, fn string, effect_type string, target string, source string, meta map<string,string>, line int"


def effects(spark, *rows):
    return spark.createDataFrame([("s", i, r[3] if len(r) > 3 else "f", r[0], r[1], r[2], r[4] if len(r) > 4 else {}, 1) for i, r in enumerate(rows)], EFFECT)


def matched(spark, *rows):
    return {r.rule_id for r in R.rule_hits(effects(spark, *rows)).collect()}


def test_rules_match_and_must_not_match(spark):
    assert "SCRIPTCTRL_001" in matched(spark, ("com_create", "MSScriptControl.ScriptControl", "vlax-create-object"), ("com_create", "ADODB.Stream", "x"), ("file_write", "a.wsf", "open"))
    assert "SCRIPTCTRL_001" not in matched(spark, ("com_create", "Excel.Application", "vlax-create-object"), ("file_write", "a.csv", "open"))
    assert "REACT_PROP_001" in matched(spark, ("com_invoke", "vlr-dwg-reactor", "x"), ("file_read", "a", "findfile"), ("file_write", "acad.lsp", "vl-file-copy"))
    assert "REACT_PROP_001" not in matched(spark, ("com_invoke", "vlr-dwg-reactor", "x"))
    assert "REC_FAS_PROP_001" in matched(spark, ("file_read", "findfile", "recovered_fas_module"), ("file_write", "vl-file-copy acaddoc.lsp", "recovered_fas_module"))
    assert "REC_FAS_PROP_001" not in matched(spark, ("file_write", "b.txt", "vl-file-copy"))
    assert "NET_STUB_001" in matched(spark, ("network_connect", "http://x.example/a?b=1", "fn_1"))
    assert "NET_STUB_001" not in matched(spark, ("network_connect", "http://x.example/", "update-check"))
    assert "STARTUP_LOAD_001" in matched(spark, ("file_read", "acaddoc.lsp", "load"))
    assert "PROC_EXEC_001" in matched(spark, ("process_create", "cmd.exe /c del", "startapp"))
    assert not matched(spark, ("file_read", "data.txt", "read-line"))


def test_repeated_hits_count(spark):
    hits = R.rule_hits(effects(spark, *[("registry_modify", rf"HKCU\Software\Microsoft\Windows\CurrentVersion\Run\{i}", "vl-registry-write") for i in range(3)]))
    assert {r.rule_id: r.hits for r in hits.collect()}["REGISTRY_001"] == 3


def test_node_rules(spark):
    samples = spark.createDataFrame(
        [("hook", '(defun s::startup () (princ))'), ("copy", '(vl-file-copy (findfile "acad.vlx") "x")'), ("none", '(defun c:go () (princ "x"))')], "sample_id string, text string"
    )
    hits = {(r.sample_id, r.rule_id) for r in R.rule_hits(E.effects_of(lisp.facts(samples)), R.top_nodes(lisp.facts(samples))).collect()}
    assert ("hook", "STARTUP_HOOK_001") in hits and ("copy", "STARTUP_COPY_STR_001") in hits
    assert not [h for h in hits if h[0] == "none"]


@pytest.mark.parametrize("rule, floor", [("PROC_EXEC_001", 0.76), ("REACT_PROP_001", 0.74), ("NET_STUB_001", 0.68)])
def test_risk_is_at_least_the_floor(spark, rule, floor):
    hits = spark.createDataFrame([("s", rule, "n", 0.9, 1)], "sample_id string, rule_id string, name string, severity double, hits bigint")
    e = S.rule_evidence(hits)
    z = F.lit(0.0)
    assert e.select(S.risk(S.Parameters(), F.col("rule_evidence"), z, z, z, z, F.col("floor")).alias("r")).first().r >= floor


def test_fusion_of_verdicts(spark):
    rows = [("BENIGN", 0.40, 0.5, "MALICIOUS", 0.95), ("BENIGN", 0.10, 0.5, "MALICIOUS", 0.70), ("MALICIOUS", 0.8, 0.5, "BENIGN", 0.9), ("BENIGN", 0.1, 0.5, None, 0.0)]
    df = spark.createDataFrame(rows, "v string, risk double, t double, label string, c double")
    v, why = S.fused_verdict(F.col("v"), F.col("risk"), F.col("t"), F.col("label"), F.col("c"))
    got = [tuple(r) for r in df.select(v, why).collect()]
    assert got == [("MALICIOUS", "semantic-escalation"), ("SUSPICIOUS", "rule-llm-disagreement"), ("MALICIOUS", "strong-rule"), ("BENIGN", "rule-only")]


def test_label_scores(spark):
    df = spark.createDataFrame([("MALICIOUS", 0.8), ("BENIGN", 0.8), ("SUSPICIOUS", 0.9), ("MALICIOUS", 7.0)], "l string, c double")
    assert [round(r[0], 6) for r in df.select(A.label_score(F.col("l"), F.col("c"))).collect()] == [0.9, 0.1, 0.5, 1.0]


def test_dedup_keeps_the_first_and_caps(spark):
    df = effects(spark, ("file_write", "a", "open"), ("file_write", "a", "open"), ("file_read", "b", "x"), ("file_read", "", "x"), ("com_create", "c", "y"))
    assert sorted(r.seq for r in E.dedup_cap(df).collect()) == [0, 2, 4]
    assert sorted(r.seq for r in E.dedup_cap(df, limit=2).collect()) == [0, 2]


def test_first_lifting_rule_wins(spark):
    df = effects(spark, ("file_write", "c:/acad.lsp", "open"), ("file_write", "fn", "open"), ("com_create", "", "vl-load-com"), ("registry_modify", "HK\\Run", "x"), ("data_destroy", "u", "eval"))
    got = {r.seq: r.rule_id for r in E.lifted(df).collect()}
    assert got == {0: "PERSIST_001", 1: "TEMP_FILE_WRITE", 2: "BENIGN_COM_INIT", 3: "PERSIST_002", 4: "DEFAULT"}


def test_technique_keeps_the_maximum(spark):
    nodes = R.top_nodes(lisp.facts(spark.createDataFrame([("s", "(load \"x.lsp\")")], "sample_id string, text string")))
    got = {r.technique: r.confidence for r in T.techniques(effects(spark, ("file_read", "acad.lsp", "load"), ("process_create", "notepad", "startapp")), nodes).collect()}
    assert got["T1059.007"] == 0.78 and got["T1547.001"] == 0.95


def edges(spark, *pairs):
    return spark.createDataFrame([("s", a, b) for a, b in pairs], "sample_id string, caller string, callee string")


def test_two_functions_on_a_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("c", "a"), ("d", "d"))
    comp = {x.fn: x.component for x in G.strong_components(e).collect()}
    assert comp == {"a": "a", "b": "a"}
    m = G.component_metrics(G.strong_components(e), e).first()
    assert m["size"] == 2 and m.strength == 1.0 and m.entries == ["a"]
    assert {(x.caller, x.callee) for x in G.back_edges(e).collect()} == {("b", "a"), ("d", "d")}


def test_walked_and_coloured_cycles_agree_with_the_closure(spark):
    import random

    rng = random.Random(4)
    pairs = [(g, f"f{rng.randrange(14)}", f"f{rng.randrange(14)}") for g in "pq" for _ in range(20)] + [("r", f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    e = spark.createDataFrame(pairs, "sample_id string, caller string, callee string").coalesce(1)
    reach = {(r.sample_id, r.src, r.dst) for r in G.closure(e).collect()}
    want = {}
    for g, a, b in reach:
        if (g, b, a) in reach and a != b:
            want[(g, a)] = min(want.get((g, a), a), a, b)
    for walked in (0, 1000):
        assert {(r.sample_id, r.fn): r.component for r in G.strong_components(e, walked).collect()} == want
    some = spark.createDataFrame([("p", "f1"), ("r", "c2")], "sample_id string, fn string")
    assert {(r.sample_id, r.src, r.dst) for r in G.closure(e, some).collect()} == {x for x in reach if x[:2] in (("p", "f1"), ("r", "c2"))}
    assert G.strong_components(e.limit(0)).count() == 0


def test_calls_through_aliases(spark):
    s = "sample_id string, fn string, name string, line int"
    calls = spark.createDataFrame([("s", "main", "g", 1), ("s", "main", "loc", 2), ("s", "main", "none", 3)], s)
    functions = spark.createDataFrame([("s", "main"), ("s", "real"), ("s", "__toplevel__")], "sample_id string, fn string")
    aliases = spark.createDataFrame([("s", "__toplevel__", "g", "h"), ("s", "__toplevel__", "h", "real"), ("s", "main", "loc", "real"), ("s", "other", "none", "real")], "sample_id string, fn string, name string, target string")
    assert {(r.caller, r.callee) for r in G.call_targets(calls, functions, aliases).collect()} == {("main", "real")}


def test_calls_through_a_long_chain_of_aliases(spark):
    calls = spark.createDataFrame([("s", "main", "a0", 1)], "sample_id string, fn string, name string, line int").coalesce(1)
    functions = spark.createDataFrame([("s", "main"), ("s", "real")], "sample_id string, fn string").coalesce(1)
    steps = [("s", "main", f"a{i}", f"a{i + 1}") for i in range(65)] + [("s", "main", "a65", "real"), ("s", "main", "a9", "a3")]
    aliases = spark.createDataFrame(steps, "sample_id string, fn string, name string, target string").coalesce(1)
    assert [(r.caller, r.callee) for r in G.call_targets(calls, functions, aliases).collect()] == [("main", "real")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components_agree_with_union_find(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in C.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == want


def test_convergence_matches_the_sequential_rule(spark):
    lines = ["a"] * 7 + ["b", "a", "b"] * 20 + ["", "c"] * 6
    rows = X.line_rows(spark.createDataFrame([(1, "\n".join(lines))], "id int, t string"), "id", "t")
    got = [r.line for r in X.converge_rows(rows, "id", "pos", "k").orderBy("pos").collect()]
    assert got == lisp.converge_lines("\n".join(lines)).split("\n")


def test_decoded_runs(spark):
    rows = [(1, i, c) for i, c in enumerate([72, 105, 33, None, 65, 66])] + [(2, 0, 72)]
    df = spark.createDataFrame(rows, "id int, seq int, c int")
    got = X.decoded_runs(df, "id", "seq", F.col("c").isNotNull(), F.col("c")).collect()
    assert [(r.id, r.decoded) for r in got] == [(1, "Hi!")]


def test_text_scalars(spark):
    df = spark.createDataFrame([("x ; note\n(y \"a;b\") \r\n",)], "t string")
    assert df.select(X.strip_comments(F.col("t"))).first()[0] == "x\n(y \"a\n"
    df = spark.createDataFrame([("junk\n  (setq a 1)\n(b)",), ("only junk",)], "t string")
    assert [r[0] for r in df.select(X.drop_preamble(F.col("t"))).collect()] == ["  (setq a 1)\n(b)", "only junk"]
    df = spark.createDataFrame([("Sub A()\nDim x As Long\nEnd Sub",), ("(defun a ())",)], "t string")
    assert [r[0] for r in df.select(X.is_vba(F.col("t"))).collect()] == [True, False]
    df = spark.createDataFrame([(0x1F600, "12ab"), (65, "x")], "c int, s string")
    assert [tuple(r) for r in df.select(X.character(F.col("c")), X.int_prefix(F.col("s"))).collect()] == [("\U0001f600", 12), ("A", None)]


def test_set_compare_and_summary(spark):
    s = "k string, item string"
    e = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("a", "1")], s)
    r = spark.createDataFrame([("a", "2"), ("a", "3")], s)
    got = {x.k: (x.matched, x.missed, x.unexpected) for x in A.set_compare(e, r, "k").collect()}
    assert got == {"a": (1, 1, 1), "b": (0, 1, 0)}
    assert A.set_summary(A.set_compare(e, r, "k")).first().recall == round(1 / 3, 6)


def test_folded_keeps_the_end_of_a_chain(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    uses = spark.createDataFrame([("b", "a"), ("c", "b")], "name string, dep string")
    ext = spark.createDataFrame([("c",)], "name string")
    assert [r[0] for r in A.folded(names, uses, ext).collect()] == ["c"]


def test_pairs_by_stem(spark):
    rows = [("p/tool_1.fas", ".fas"), ("q/tool_2.lsp", ".lsp"), ("p/only_3.fas", ".fas"), ("q/alone_4.lsp", ".lsp")]
    got = A.strict_pairs(spark.createDataFrame(rows, "path string, ext string")).collect()
    assert sum(r.compiled is not None and r.source is not None for r in got) == 1
    assert sum(r.source is None for r in got) == 1 and sum(r.compiled is None for r in got) == 1


def test_grid_has_its_candidates():
    g = A.grid()
    assert len(g) == 1860 and [c[0] for c in g] == list(range(1860))


def test_ranked_below_equals_ranking(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("l"), F.md5(F.col("id").cast("string")).alias("h"))
    got = {r.id for r in A.ranked_below(df, ["l"], "h", 0.4).where("chosen").collect()}
    want = set()
    for k in range(3):
        rows = sorted((r.h, r.id) for r in df.where(f"l = {k}").collect())
        want |= {i for _, i in rows[: round(len(rows) * 0.4)]}
    assert got == want


def test_source_keys(spark):
    rows = [("p/white_road_tool_000012.lsp",), ("x/sample_bridge_kerb.fas",), ("y/0123456789abcdef0_duct_a.lsp",), ("z/.lsp",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(A.source_key(F.col("s"))).collect()]
    assert got == ["src:road", "src:bridge_kerb", "src:duct_a", "sample:"]


def test_model_payloads(spark):
    rows = [(1, 'text {"label": "malicious", "confidence": 0.8, "reasoning": "r", "functions": ["a", "b"]} more'), (2, "no json"), (3, '{"verdict": "benign", "summary": {"k": 1}}'), (4, None)]
    got = {r.id: r for r in N.parsed(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert (got[1].label, got[1].confidence, got[1].summary, got[1].functions) == ("MALICIOUS", 0.8, "r", 2)
    assert not got[2].valid and not got[4].valid
    assert got[3].label == "BENIGN" and "k" in got[3].summary


def test_small_scripts_end_to_end(spark):
    rows = [
        ("load.lsp", '(load "acaddoc.lsp")'),
        ("hook.lsp", '(defun s::startup () (vl-file-copy (findfile "acad.lsp") "acaddoc.lsp"))'),
        ("run.lsp", '(vl-registry-write "HKEY_CURRENT_USER\\\\Software\\\\Microsoft\\\\Windows\\\\CurrentVersion\\\\Run" "x" "y")'),
        ("white_fso.lsp", '(setq o (vlax-create-object "Scripting.FileSystemObject"))'),
        ("white_plain.lsp", '(defun c:go () (princ "done"))'),
        ("empty.lsp", ""),
    ]
    df = spark.createDataFrame([(k, f"r/{k}", "lsp", t) for k, t in rows], "sample_id string, path string, input_type string, text string")
    got = {r.sample_id: r.verdict for r in pipeline.scores(df).collect()}
    assert len(got) == 6
    assert [got[k] for k in ("load.lsp", "hook.lsp", "run.lsp")] == ["MALICIOUS"] * 3
    assert [got[k] for k in ("white_fso.lsp", "white_plain.lsp", "empty.lsp")] == ["BENIGN"] * 3


def test_medians_of_any_size(spark):
    from triagelake.operators.evaluation import medians

    rng = np.random.default_rng(3)
    groups = {
        "even": list(rng.lognormal(3, 2, 4000)), "odd": list(rng.integers(0, 50, 3001).astype(float)), "one": [7.0], "two": [1.0] * 500 + [2.0] * 500,
        "same": [5.0] * 900, "far": [0.0] * 10 + [1e12] * 11,
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    for limit in (50, 100_000):
        assert medians(df, "g", "v", limit) == [(g, float(np.median(groups[g]))) for g in sorted(groups)]
    assert medians(df.limit(0), "g", "v") == []


def test_source_split_is_greedy(spark):

    rows = [(100 * k + i, f"d/src{k}a_part{k}.lsp", "MALICIOUS" if (i + k) % 3 else "BENIGN") for k in range(30) for i in range(k % 7 + 1)] + [(9999, None, None)]
    got = A.source_split(spark.createDataFrame(rows, "stat_id long, sample string, label string")).collect()
    of = {r.source: r.split for r in got}
    assert len(got) == len(rows) and all(of[r.source] == r.split for r in got)
    m = sum(r[2] == "MALICIOUS" for r in rows)
    dev = [r for r in rows if any(g.stat_id == r[0] and g.split == "dev" for g in got)]
    assert abs(sum(r[2] == "MALICIOUS" for r in dev) - 0.55 * m) <= 3 and abs(len(dev) - 0.55 * len(rows)) <= 5


def test_hot_tokens_give_the_same_pairs(spark):
    import random


    rng = random.Random(6)
    token = lambda: rng.choice(["hot", "hot:x", "warm", *[f"t{i}" for i in range(40)]])
    left = spark.createDataFrame([(f"a{i}", token()) for i in range(25) for _ in range(6)], "item string, token string")
    right = spark.createDataFrame([(f"b{i}", token()) for i in range(40) for _ in range(5)], "item string, token string")
    plain = sorted(map(tuple, A.overlap_pairs(left, right).collect()))
    assert sorted(map(tuple, A.overlap_pairs(left, right, hot=3).collect())) == plain and len(plain) > 50


def test_macros_become_scripts(spark):

    macro = '''Private Sub AcadDocument_BeginClose()
  Set o = CreateObject("WScript.Shell")
  Shell "cmd.exe /c del, all"
  Shell regedit /s x.reg
  Open "C:\\a b\\out.txt" For Output As #1
  x = "HKEY_CURRENT_USER\\Software\\Run"
  command "undefine", "line"
  p = "C:\\my files\\acad.dwt"
  q = "http://host.example/a"
  r = "acaddoc.lsp"
End Sub
'''
    df = spark.createDataFrame([("m", "r/m.lsp", macro, "lsp-vba"), ("s", "r/s.lsp", "(command \"line\")", "lsp")], "sample_id string, path string, text string, input_type string")
    kinds = {}
    for r in X.vba_behaviours(df.where("sample_id = 'm'")).orderBy("kind", "pos").collect():
        kinds.setdefault(r.kind, []).append(r.value)
    assert kinds["shell"] == ["cmd.exe /c del, all", "regedit /s x.reg"] and kinds["target"] == ["C:\\my files\\acad.dwt", "acaddoc.lsp"]
    assert kinds["com_object"] == ["wscript.shell"] and kinds["hook"] == ["AcadDocument_BeginClose"]
    script = df.where("sample_id = 'm'").select(X.macro_script(F.col("text"))).first()[0]
    assert script.startswith("(defun s::startup ()\n  (vlr-dwg-reactor") and script.count("(defun vba-payload") == 1 and script.count("AutoEmbedding") == 1
    f = pipeline.script_facts(df)
    got = {(r.sample_id, r.effect_type) for r in f.effects.collect()}
    assert {("m", "com_create"), ("m", "file_write"), ("m", "registry_modify")} <= got
    assert ("m", "s::startup") in {(r.sample_id, r.fn.lower()) for r in f.functions.collect()}


def test_effects_go_up_the_calls(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("x", "a"))
    f = spark.createDataFrame([("s", "c", "file_write"), ("s", "c", "file_write"), ("s", "a", "file_read")], "sample_id string, fn string, effect_type string")
    got = {(r.fn, r.effect_type): (r.n, r.own) for r in E.all_effects(f, e).collect()}
    assert got == {
        ("c", "file_write"): (2, True), ("b", "file_write"): (1, False), ("a", "file_write"): (1, False), ("x", "file_write"): (1, False),
        ("a", "file_read"): (1, True), ("x", "file_read"): (1, False),
    }
