import pytest

from triagelake.functions import vocabulary as V
from triagelake.sources import lisp as L


def effects(source):
    return [e[1:4] for e in L.script_facts(source)[1].effects]


def test_lines_that_repeat():
    assert L.converge_lines("\n\n".join(["(a)"] * 7)).count("(a)") == 4
    assert L.converge_lines("(a)\n(b)\n(a)\n(b)\n(a)").count("(a)") == 3
    kept = L.converge_lines("\n".join(["(a)", "(b)"] * 26)).split("\n")
    assert kept.count("(a)") == kept.count("(b)") == 16


def test_nodes_that_repeat():
    forms = L.parse("(x 1)" * 7)
    assert len(L.converge(forms, L.signature)) == 4
    assert len(L.converge(L.parse("(x 1)(y 2)" * 26), L.signature)) == 32


def test_parse_quotes_numbers_and_open_lists():
    top = L.parse("(setq a '(1 2.5 -3) b \"q\\\"\\n\")")
    assert top[0].kind == "call" and top[0].value == "setq"
    assert [k.kind for k in top[0].kids] == ["symbol", "quote", "symbol", "string"]
    assert [k.value for k in top[0].kids[1].kids[0].kids] == [1, 2.5, -3]
    assert top[0].kids[3].value == 'q"\n'
    assert L.parse("(a (b c")[0].kids[0].value == "b"
    assert L.parse("") == [] and L.parse(") )") == []


def test_depth_limit():
    with pytest.raises(L.TooDeep):
        L.parse("(" * (V.MAX_DEPTH + 1))


def test_calls_of_an_unclosed_definition_are_lifted():
    forms = L.lift_calls(L.parse("(defun s::startup (/ (load \"x.lsp\") (princ))"))
    assert [f.value for f in forms] == ["defun", "/", "load", "princ"]
    assert [f.value for f in L.lift_calls(L.parse("(defun f (a / b) (g))"))] == ["defun", "a"]


def test_names():
    assert L.plain_name("ACAD:VLAX-INVOKE-METHOD") == "vlax-invoke-method"
    assert L.plain_name("open[XYZ") == "open" and L.plain_name("'load'") == "load" and L.plain_name("princ!!") == "princ"


def test_handle_is_followed_to_its_file():
    found = effects('(defun f () (setq h (open "c:/acad.lsp" "w")) (write-line "x" h))')
    assert ("file_write", "c:/acad.lsp", "write-line") in found


def test_strings_are_put_together():
    found = effects('(setq p (strcat "acad" (chr 46) "lsp")) (load p)')
    assert ("file_read", "acad.lsp", "load") in found


def test_unknown_calls():
    assert not [e for e in effects('(note "http://help.example/page" "see the manual")') if e[0] == "network_connect"]
    assert ("network_connect", "http://x.example/a?id=1", "note") in effects('(note "http://x.example/a?id=1" "b")')
    assert ("file_write", "payload.dcl", "~") in effects('(~ "http://x.example/a" "payload.dcl")')
    assert ("registry_modify", "HKEY_CURRENT_USER\\x", "wr") in effects('(wr "HKEY_CURRENT_USER\\\\x")')


def test_copy_reads_and_writes_and_print_does_not():
    found = effects('(vl-file-copy "a.lsp" "b.lsp") (princ "x") (eval x) (command "undefine" "LINE") (command "line" p q)')
    assert ("file_read", "a.lsp", "vl-file-copy") in found and ("file_write", "b.lsp", "vl-file-copy") in found
    assert ("data_destroy", "unknown", "eval") in found
    assert ("command_hijack", "LINE", "command") in found and len(found) == 4


def test_facts_survive_bad_rows(spark):
    rows = [("deep", "(" * 5000), ("ok", "(defun c:go () (load \"acad.lsp\"))"), ("none", None), ("empty", "")]
    got = L.facts(spark.createDataFrame(rows, "sample_id string, text string")).collect()
    kinds = {(r.sample_id, r.fact) for r in got}
    assert ("deep", "error") in kinds and ("ok", "effect") in kinds
    assert not [k for k in kinds if k[0] in ("none", "empty")]
    assert L.facts(spark.createDataFrame([], "sample_id string, text string")).count() == 0
