from pyspark.sql import functions as F

from tests.test_sources import code_frame
from triagelake.operators import passes as P
from triagelake.operators import recovery as V
from triagelake.sources import bytecode as B
from triagelake.sources import lisp

EFFECT = "sample_id string, seq int, fn string, effect_type string, target string, source string, meta map<string,string>, line int"
INSTR = "sample_id string, fn string, block string, seq int, opcode string, result string, operands array<string>"


def test_passes(spark):
    rows = [
        ("s", "f", "b0", 0, "CALL", "t0", ["strcat", "a", "b"]), ("s", "f", "b0", 1, "CALL", "t1", ["chr", "97"]), ("s", "f", "b0", 2, "CALL", "t2", ["atoi", "12x"]), ("s", "f", "b0", 3, "CALL", "t3", ["chr", "name"]),
        ("s", "f", "b0", 4, "NOP", None, []), ("s", "f", "b0", 5, "ASSIGN", "x", ["x"]), ("s", "f", "b1", 6, "ASSIGN", "y", ["x"]), ("s", "f", "b2", 7, "ASSIGN", "z", ["x"]),
    ]
    i = spark.createDataFrame(rows, INSTR)
    got = {r.seq: (r.opcode, list(r.operands)) for r in P.fold_constants(i).collect()}
    assert got[0] == ("ASSIGN", ["ab"]) and got[1] == ("ASSIGN", ["a"]) and got[2] == ("ASSIGN", ["12"]) and got[3][0] == "CALL"
    assert {r.seq for r in P.prune_noops(i).collect()} == {0, 1, 2, 3, 6, 7}
    entries = spark.createDataFrame([("s", "b0")], "sample_id string, block string")
    succ = spark.createDataFrame([("s", "b0", "b1"), ("s", "b2", "b1")], "sample_id string, src string, dst string")
    assert {r.block for r in P.prune_unreachable(i, entries, succ).collect()} == {"b0", "b1"}


def test_bindings_and_classes(spark):
    calls = spark.createDataFrame([("s", "main", "f", ["1", "2", "3"])], "sample_id string, fn string, callee string, args array<string>")
    fns = spark.createDataFrame([("s", "f", ["a", "b"])], "sample_id string, fn string, params array<string>")
    assert {(r.parameter, r.argument) for r in P.parameter_bindings(calls, fns).collect()} == {("a", "1"), ("b", "2")}
    df = spark.createDataFrame([("C:\\x\\acad.lsp",), ("a.mnu",), ("",), ("cdate",)], "p string")
    level, kind = P.path_resolution(F.col("p"))
    assert [tuple(r) for r in df.select(level, kind).collect()][:3] == [("full", "startup"), ("partial", "menu"), ("unresolved", "data")]
    k, s = P.environment_check(F.col("p"))
    assert tuple(df.select(k, s).collect()[3]) == ("TIME", "high")


def test_merge_keeps_own_effects_first(spark):
    own = spark.createDataFrame([("s", 0, "f", "file_write", "a", "open", {}, 1)], EFFECT)
    other = spark.createDataFrame([("s", 0, "m", "file_write", "a", "open", {"recovered_from": "x"}, None), ("s", 1, "m", "com_create", "b", "x", {}, None)], EFFECT)
    got = {(r.effect_type, r.fn) for r in V.merge_effects(own, other).collect()}
    assert got == {("file_write", "f"), ("com_create", "m")}


BEHAVIOUR = "sample_id string, kind string, category string, functions array<int>, evidence array<string>"


def test_behaviours_stand_at_functions_or_the_module(spark):
    b = spark.createDataFrame(
        [("s", "reactor_persistence", "persistence", [4], ["[VLR-DWG-Reactor"]), ("s", "file_search_copy_propagation", "propagation", [], ["findfile", "vl-file-copy"]), ("s", "wsf_payload_output", "file", [4], [".WSF", "ScriptControl"])], BEHAVIOUR
    )
    assert {(r.fn, r.effect_type, r.target, r.source) for r in V.behaviour_effects(b).collect()} == {
        ("fn_0004", "com_invoke", "[VLR-DWG-Reactor", "fn_0004"), ("fn_0004", "file_write", ".WSF", "fn_0004"),
        (V.MODULE, "file_read", "findfile", V.MODULE), (V.MODULE, "file_write", "vl-file-copy", V.MODULE),
    }
    assert {(r.fn, r.behaviour) for r in V.behaviour_summaries(b).collect()} == {("fn_0004", "reactor_persistence"), (V.MODULE, "file_search_copy_propagation"), ("fn_0004", "wsf_payload_output")}
    e = V.recovered_evidence(b).first()
    assert e.entry_points == ["fn_0004"] and e.code_loader_targets == [".WSF", "vl-file-copy"] and e.propagation_likely and len(e.methods) == 3


def compiled(spark):
    """A file whose functions search, copy, and hook a reactor; the top level
    names the second one."""
    call = lambda i: [0x35, 1, i, 0, 0]
    push = lambda i: [0x09, i, 0]
    frame = [0x14, 0, 0, 0, 0]
    code = [1, 0, 0, 0, *frame, *push(0), *call(0), *push(1), *call(1), 0x16, *frame, *push(2), *call(2), *call(3), 0x16]
    symbols = ["findfile", "VL-FILE-COPY", "vlr-dwg-reactor", "fn_0004"]
    strings = ["acaddoc.lsp", "x", "y", "HKEY_CURRENT_USER\\Software\\Microsoft\\Windows Script Host\\Settings", "payload.WSF", "ScriptControl", "ADODB.Stream", "M=$(edtime,$(getvar,date),YYMODD)", None]
    return spark.createDataFrame([("k", bytearray(code), symbols, strings), ("none", None, None, None)], "sample_id string, code binary, symbols array<string>, strings array<string>")


def test_six_behaviours_of_compiled_code(spark):
    files = compiled(spark)
    pool = files.select("sample_id", F.explode("strings").alias("value"))
    i = B.instructions(files)
    got = {r.kind: (r.category, r.functions, r.evidence) for r in B.behaviours(i, pool).collect()}
    assert set(got) == {k for k, _, _ in B.BEHAVIOURS}
    assert got["file_search_copy_propagation"] == ("propagation", [4], ["findfile", "vl-file-copy"])
    assert got["reactor_persistence"][1] == [26] and got["script_payload_staging"][1] == [] and got["wsh_warning_suppression"][1] == []
    assert set(r.kind for r in B.behaviours(i).collect()) == {"file_search_copy_propagation", "reactor_persistence"}


def test_recovered_code_is_part_of_the_scores(spark):
    from triagelake.plans import pipeline

    files = compiled(spark)
    resources = spark.createDataFrame([("k", 0, "http://host.example/x")], "sample_id string, idx int, value string")
    found = pipeline.recovered(files, resources)
    samples = spark.createDataFrame([("k", "r/k.fas", None, "fas"), ("none", "r/n.fas", None, "fas")], "sample_id string, path string, text string, input_type string")
    f = pipeline.script_facts(samples, found)
    assert {r.fn for r in f.functions.collect()} == {"fn_0004", "fn_001a"}
    from triagelake.operators import graph as G

    assert {(r.caller, r.callee) for r in G.call_targets(f.calls, f.functions, f.aliases).collect()} == {("fn_001a", "fn_0004")}
    assert {("file_read", "findfile"), ("network_connect", "http://host.example/x"), ("com_create", "ADODB.Stream")} <= {(r.effect_type, r.target) for r in f.effects.collect()}
    scores = {r.sample_id: r for r in pipeline.scores(samples, extra=found).collect()}
    assert scores["k"].risk > scores["none"].risk and scores["k"].effects >= 8 and scores["none"].effects == 0


def test_names_expressions_and_rendering(spark):
    i = B.instructions(code_frame(spark))
    names = V.function_names(i)
    assert names.first().name.startswith("fn_")
    e = V.expressions(i).first()
    assert e.callee == "foo" and e.expression.startswith("(foo ")
    assert "(foo " in V.rendered(names, V.expressions(i)).first().source
    assert V.light_mode(B.frames(i), B.bindings(i)).first().light is False


def test_all_calls_and_arguments_are_rendered(spark):
    def files(code):
        return spark.createDataFrame([("s", bytearray([1, 0, 0, 0, 0x14, 0, 0, 0, 0, *code, 0x16]), ["f", "g"], [])], "sample_id string, code binary, symbols array<string>, strings array<string>")

    i = B.instructions(files([0x35, 0, 0, 0, 0, 0x0A] * 200))
    names, e = V.function_names(i), V.expressions(i)
    assert V.rendered(names, e).first().source.count("(f)") == 200
    short = V.rendered(names, e, compact=150).first().source
    assert short.count("(f)") == 150 and "... 50 additional calls omitted" in short
    # g takes 70 arguments; the next call sees its result and nothing else
    i = B.instructions(files([0x01] * 70 + [0x35, 70, 1, 0, 0, 0x35, 2, 0, 0, 0]))
    got = [r.expression for r in V.expressions(i).orderBy("seq").collect()]
    assert got == [f"(g{' nil' * 70})", f"(f ? (g{' nil' * 70}))"]


def test_items_and_comparison(spark):
    src = V.source_items(spark.createDataFrame([("s", '(defun Go () (vl-file-copy "some file" b) (foo))'), ("n", None)], "sample_id string, text string"))
    assert {(r.kind, r.item) for r in src.collect()} == {("function", "go"), ("api", "vl-file-copy"), ("string", "some file")}
    got = {r.kind: (r.matched, r.missed) for r in V.compare_items(src, src.where("kind = 'api'")).collect()}
    assert got["api"] == (1, 0) and got["string"] == (0, 1)


def test_surface_masks_and_top_bindings(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    left = V.mask_surface(df, 0.3, 1, "k").count()
    assert 1300 < left < 1500 and V.mask_surface(df, 0.0, 1, "k").count() == 2000
    f = lisp.facts(spark.createDataFrame([("s", "(setq a 1) (defun g () (setq b 2) (vla-get-x q))")], "sample_id string, text string"))
    assert [r.name for r in V.top_bindings(f.where("fact = 'alias'")).collect()] == ["a"]
    assert {r.api for r in V.candidate_apis(f).collect()} == {"vla-get-x"}
    x = spark.createDataFrame([(["a", "b"], ["b", None, "c"])], "p array<string>, q array<string>")
    assert x.select(V.merged_unique(F.col("p"), F.col("q"))).first()[0] == ["a", "b", "c"]
