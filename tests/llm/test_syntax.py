import pytest

from triagelake.llm import source_syntax as X
from triagelake.llm.derivatives import Grammar

GOOD_LISP = [
    "", "﻿; only a note", "(a)", "'(a b)", "(a '(b . c) \"s;t(\" ; note )\n)", ";| block\n ( \" |; (a)", "(a \"two\nlines \\\" ( \")", "(a)\r(b)\r\n(c)",
    ";; ======= title\n(a)", "(a \"\n=======\n\")", ";|\n<<<<<<< HEAD\n|;(a)", "(a ;| in |; b)", "()", "(a <<<<<<< b)",
]
BAD_LISP = {
    "(a": "truncated", "(a))": "failed", "a": "failed", "(a) b": "failed", "(a \"open": "truncated", ";| open (a)": "truncated", "(a)\n=======\n(b)": "failed",
    "(a\n<<<<<<< HEAD\nb)": "failed", "(a)\n>>>>>>> x/y\n": "failed", "'": "truncated", "' a": "failed", "\"s\"": "failed", "(a)\r=======\r(b)": "failed",
}
HEAD = 'Attribute VB_Name = "m"\nOption Explicit\n'
GOOD_VBA = [
    "", "﻿' note", HEAD, "Sub a(b, _\n  c)\nIf x And _\n  y Then\nz = 1\nEnd If\nEnd Sub", "Sub a()\nFor i = 1 To 2\nFor j = 1 To 2\nNext j, i\nEnd Sub",
    HEAD + "Private a As Double\nPublic Sub b()\nEnd Sub\n", "Sub a()\r\n  If x > 1 Then\r\n y = 2\r\n Else\r\n z\r\n End If\r\nEnd Sub",
    "Sub a()\nIf x = 1 Then y = 2\nFor i = 0 To 3\nNext i\nFor j = 1 To 2\nNext\nEnd Sub", "Function f(a As Long)\nWith x\nDo While y < 3\nLoop\nEnd With\nEnd Function",
    "Sub a()\nx = \"it's \"\"quoted\"\" If Then\" ' Loop\nEnd Sub", "Sub a()\n' <<<<<<< note\nRem =======\nEnd Sub",
]
BAD_VBA = [
    "Sub a()\n", "Sub a()\nEnd Function", "x = 1", "Sub a()\nIf x Then\nEnd Sub", "Sub a()\nFor i = 0 To 3\nNext j\nEnd Sub", "Sub a()\nLoop\nEnd Sub", "Sub a()\nx = \"open\nEnd Sub",
    "Sub a()\n=======\nEnd Sub", HEAD + "Private a As", "Sub a()\nSub b()\nEnd Sub\nEnd Sub", "(defun a ())", "; note", "Sub a()\nWith x\nEnd Sub", "Sub a()\nElse\nEnd Sub", "End Sub",
    "Sub a()\nFor i = 1 To 2\nFor j = 1 To 2\nNext i, j\nEnd Sub", "Sub a()\nx = 1 + _",
    "Private Const A = 1\n", "Type T\nx As Long\nEnd Type", "Dim a, b As Long\n", "Property Get z()\nEnd Property",
]


@pytest.mark.parametrize("text", GOOD_LISP)
def test_good_lisp(text):
    assert X.judge("lsp", text)[0] == "ok"


@pytest.mark.parametrize("text", BAD_LISP)
def test_bad_lisp(text):
    assert X.judge("lsp", text)[0] == BAD_LISP[text]


@pytest.mark.parametrize("text", GOOD_VBA)
def test_good_vba(text):
    assert X.judge("lsp-vba", text)[0] == "ok"


@pytest.mark.parametrize("text", BAD_VBA)
def test_bad_vba(text):
    assert X.judge("lsp-vba", text)[0] != "ok"


WHOLE = """Option Base 1
Private Const A = 1, B = 2
Private Type T
  x As Long
  y As String * 5
End Type
Enum E
  a = 1
End Enum
Dim p, q As Long
Declare PtrSafe Function g Lib "k" () As Long
Property Get Z() As Long
  Select Case x
  Case 1, 2
    y = 1
  Case Else
    While x
    Wend
  End Select
End Property
"""


def test_the_whole_language_is_a_parameter():
    assert X.judge("lsp-vba", WHOLE, full=True)[0] == "ok" and X.judge("lsp-vba", WHOLE)[0] != "ok"
    for x in ("  End Select\n", "    Wend\n", "End Type\n", "End Enum\n", "  Case Else\n    While x\n"):
        assert X.judge("lsp-vba", WHOLE.replace(x, ""), full=True)[0] != "ok"


def test_the_failing_token_is_named():
    assert X.judge("lsp", "(a)\n\n(b))") == ("failed", 3, "close")
    assert X.judge("lsp-vba", "Sub a()\nLoop\nEnd Sub") == ("failed", 2, "loop")


def test_deep_nesting_and_long_files():
    n = 20_000
    assert X.judge("lsp", "(" * n + ")" * n)[0] == "ok"
    assert X.judge("lsp", "(" * n + ")" * (n - 1))[0] == "truncated"
    assert X.judge("lsp", "(a b)\n" * 50_000)[0] == "ok"


def test_tables_are_forgotten_when_they_grow(monkeypatch):
    from triagelake.llm import derivatives

    monkeypatch.setattr(derivatives, "LIMIT", 50)
    g = Grammar().define(X._lisp_rules)
    for _ in range(3):
        assert g.recognise(["open"] * 40 + ["close"] * 40)[0] == "ok"


def test_files_and_rates(spark):
    rows = [("a", "r/x/a.lsp", "lsp", "(a"), ("a", "r/x/a.lsp", "LSP ", "(a)"), ("b", "r/b.lsp", "lsp", "(b)"), ("c", "q/c.lsp", "lsp-vba", "x"), ("d", "q/d.lsp", "lsp", None), ("e", "q/e.fas", "fas", "("), ("f", "q/f", None, "(")]
    df = spark.createDataFrame(rows, "sample_id string, path string, input_type string, text string").selectExpr("*", "1 as result", "2 as line")
    assert sorted(r.sample_id for r in X.found(df).collect()) == ["a", "c"]
    evals = spark.createDataFrame([("./r\\x\\a.lsp", "err"), ("r/x/a.lsp", ""), ("q/c.lsp", None), (None, "x")], "sample string, error string")
    got = {(r.repository, r.input_type): (r.files, r.invalid, r.evaluations, r.errors_on_invalid) for r in X.rates(df, evals).collect()}
    assert got == {("r", "lsp"): (2, 1, 2, 1), ("q", "lsp-vba"): (1, 1, 1, 0)}
    empty = spark.createDataFrame([], df.schema)
    assert X.found(empty).count() == 0 and X.rates(empty, evals).count() == 0
