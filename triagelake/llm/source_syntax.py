"""Source files that do not parse (problem 4).

Method: parsing with memoised derivatives over token streams.  A file fails at
the token whose derivative is empty; it is truncated where the derivative at
its end does not hold the empty word.

AutoLISP: at top level only lists, each with or without a quote before it,
comments and blanks.  VBA (one token a line): blocks closed by their own end,
a named Next naming its For, statements only inside procedures, and at top
level only Attribute, Option Explicit and complete declarations.  A line that
ends in a blank and an underscore goes on in the next one; ``Next j, i`` ends
two loops.  Lines left by a merge are no tokens of either language outside
comments and strings.

That is VBA as problem 4 defines it: Property, Type, Enum, Const, Declare and
declarations of several names do not stand at top level, and what a line says
within itself is not parsed.  ``full=True`` accepts the whole language there,
with Select Case and While blocks closed by their own ends.

Defined results: null texts and other input types are not judged; an empty
file, a byte-order mark and any line ends are fine.  A key that comes with
several texts is reported once, as invalid if any of its texts is.  Empty
tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.derivatives import Grammar

LANGUAGES = {"lsp": "AutoLISP", "lsp-vba": "VBA"}

_MERGE = r"^(?:<{7}|>{7}|\|{7})(?=[ \t\n]|\Z)[^\n]*|^={7}[ \t]*$"
_LISP = re.compile(
    rf"(?P<merge>{_MERGE})"
    r"|(?P<comment>;\|(?s:.*?)\|;)|(?P<cut>;\|)|(?P<note>;[^\n]*)"
    r'|(?P<string>"(?:[^"\\]|\\(?s:.))*")|(?P<tear>")'
    r"|(?P<open>\()|(?P<close>\))|(?P<quote>')"
    r"|(?P<atom>[^\s()'\";]+)",
    re.M,
)


def _lisp_rules(g: Grammar) -> int:
    opens, closes, quote = g.token("open"), g.token("close"), g.token("quote")
    atom = g.token("atom", "string")
    g.rules["items"] = g.choice(g.seq(g.name("item"), g.name("items")), 1)
    g.rules["list"] = g.seq(opens, g.name("items"), closes)
    g.rules["item"] = g.choice(atom, g.name("list"), quote)
    g.rules["top"] = g.choice(g.seq(g.name("form"), g.name("top")), 1)
    g.rules["form"] = g.choice(g.name("list"), g.seq(quote, g.name("list")))
    return g.name("top")


def lisp_tokens(text: str) -> Iterator[tuple[str, int]]:
    for m in _LISP.finditer(text):
        kind = m.lastgroup
        if kind not in ("comment", "note"):
            yield kind, m.start()
            if kind in ("cut", "tear"):
                return


_MARK = re.compile(_MERGE)
_CODE = re.compile(r"""(?:"(?:[^"]|"")*"|[^"'])*""")
_SCOPE = r"(?:(?:public|private|friend|static|global)\s+)*"
_LINE = [
    (re.compile(p + r"\s*\Z", re.I), k)
    for p, k in (
        (r"attribute\s+\w+(?:\.\w+)*\s*=\s*\S.*", "attribute"),
        (r"option\s+explicit", "option"),
        (_SCOPE + r"sub\s+\w+\s*(?:\([^()]*(?:\(\)[^()]*)*\))?", "sub"),
        (_SCOPE + r"function\s+\w+\s*(?:\([^()]*(?:\(\)[^()]*)*\))?(?:\s+as\s+\w+(?:\.\w+)*(?:\(\))?)?", "function"),
        (r"end\s+sub", "end sub"),
        (r"end\s+function", "end function"),
        (r"if\b.*\bthen", "if"),
        (r"elseif\b.*\bthen", "elseif"),
        (r"else\s*:?", "else"),
        (r"end\s+if", "end if"),
        (r"with\s+\S.*", "with"),
        (r"end\s+with", "end with"),
        (r"do(?:\s+(?:while|until)\b.*)?", "do"),
        (r"loop(?:\s+(?:while|until)\b.*)?", "loop"),
        (r"(?:dim|private|public)\s+\w+(?:\([^()]*\))?\s+as\s+(?:new\s+)?\w+(?:\.\w+)*", "declaration"),
    )
]
_FOR = re.compile(r"for\s+(?:each\s+)?(\w+)\b.*\Z", re.I)
_NEXT = re.compile(r"next(?:\s+(\w+(?:\s*,\s*\w+)*))?\s*\Z", re.I)
_GOES_ON = re.compile(r"(?:^|\s)_\s*\Z")
# what the whole language has besides
_NAME = r"\w+[%&!#@$]?(?:\s*\([^()]*\))?(?:\s+as\s+(?:new\s+)?\w+(?:\.\w+)*(?:\s*\*\s*\w+)?)?"
_FULL_LINE = [
    (re.compile(p + r"\s*\Z", re.I), k)
    for p, k in (
        (_SCOPE + r"property\s+(?:get|let|set)\s+\w+.*", "property"),
        (r"end\s+property", "end property"),
        (_SCOPE + r"type\s+\w+", "type"),
        (r"end\s+type", "end type"),
        (_SCOPE + r"enum\s+\w+", "enum"),
        (r"end\s+enum", "end enum"),
        (r"select\s+case\s+\S.*", "select"),
        (r"case\s+\S.*", "case"),
        (r"end\s+select", "end select"),
        (r"while\s+\S.*", "while"),
        (r"wend", "wend"),
        (r"option\s+(?:explicit|base\s+[01]|compare\s+\w+|private\s+module)", "option"),
        (_SCOPE + r"const\s+\w+.*=\s*\S.*", "module"),
        (_SCOPE + r"(?:declare\s+(?:ptrsafe\s+)?(?:sub|function)|event)\s+\w+.*", "module"),
        (r"(?:implements\s+\w+(?:\.\w+)*|def(?:bool|byte|int|lng|cur|sng|dbl|date|str|obj|var)\s+\S.*)", "module"),
        (rf"(?:dim|private|public|global|static)\s+(?:withevents\s+)?{_NAME}(?:\s*,\s*{_NAME})*", "declaration"),
    )
]
_LOST = re.compile(r"(?:" + _SCOPE + r"(?:sub|function)|for|with|next|do|loop|elseif|attribute|option)\b", re.I)
_WORD = re.compile(r"\w+")
_FULL_STARTS = frozenset("property type enum select case while wend const declare event implements".split())
_STARTS = frozenset("attribute option public private friend static global sub function end if elseif else with do loop dim for next".split())


def _vba_rules(g: Grammar, full: bool = False) -> int:
    t, n = g.token, g.name
    also, parts = (), ()
    if full:
        g.rules["cases"] = g.choice(g.seq(t("case"), n("body"), n("cases")), 1)
        g.rules["fields"] = g.choice(g.seq(t("line", "declaration"), n("fields")), 1)
        also = (t("module"), g.seq(t("select"), n("cases"), t("end select")), g.seq(t("while"), n("body"), t("wend")))
        parts = (
            t("module"), g.seq(t("property"), n("body"), t("end property")),
            g.seq(t("type"), n("fields"), t("end type")), g.seq(t("enum"), n("fields"), t("end enum")),
        )
    g.rules["body"] = g.choice(g.seq(n("statement"), n("body")), 1)
    g.rules["elses"] = g.choice(g.seq(t("elseif"), n("body"), n("elses")), g.seq(t("else"), n("body")), 1)
    g.rules["statement"] = g.choice(
        t("line", "declaration"),
        g.seq(t("if"), n("body"), n("elses"), t("end if")),
        g.seq(t("with"), n("body"), t("end with")),
        g.seq(t("do"), n("body"), t("loop")),
        g.bound("for", n("body"), "next"),
        *also,
    )
    g.rules["top"] = g.choice(g.seq(n("part"), n("top")), 1)
    g.rules["part"] = g.choice(
        t("attribute", "option", "declaration"),
        g.seq(t("sub"), n("body"), t("end sub")),
        g.seq(t("function"), n("body"), t("end function")),
        *parts,
    )
    return n("top")


def _vba_kind(code: str, full: bool = False):
    w = _WORD.match(code)
    first = w.group().lower() if w else ""
    if first not in _STARTS and not (full and first in _FULL_STARTS or re.match(r"def\w+\Z", first) and full):
        return "line"
    if m := _FOR.match(code):
        return ("for", m.group(1).lower())
    if m := _NEXT.match(code):
        return ("next", (m.group(1) or "").lower())
    for p, k in (*_FULL_LINE, *_LINE) if full else _LINE:
        if p.match(code):
            return k
    return "lost" if _LOST.match(code) else "line"


def vba_tokens(text: str, full: bool = False) -> Iterator[tuple[object, int]]:
    """One token a statement, which may go on over several lines."""
    at, held = 0, None
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        if _MARK.match(line):
            yield "merge", start
            continue
        m = _CODE.match(line)
        code, rest = m.group(), line[m.end() :]
        if rest.startswith('"'):
            yield "tear", start + m.end()
            return
        if held is not None:
            start, code = held[0], f"{held[1]} {code}"
        if not rest and _GOES_ON.search(code):
            held = (start, code.rstrip()[:-1])
            continue
        held, code = None, code.strip()
        if code and not code.lower().startswith("rem ") and code.lower() != "rem":
            kind = _vba_kind(code, full)
            if kind[0] == "next":
                for name in kind[1].split(","):
                    yield ("next", name.strip()), start
            else:
                yield kind, start
    if held is not None:  # a line that should go on, at the end of the file
        yield "unfinished", held[0]


_GRAMMARS: dict[str, Grammar] = {}


def judge(language: str, text: str, full: bool = False) -> tuple[str, int | None, str | None]:
    """("ok" | "failed" | "truncated", line, token kind)."""
    lisp = language == "lsp"
    name = language if lisp or not full else f"{language} full"
    g = _GRAMMARS.get(name)
    if g is None:
        g = _GRAMMARS[name] = Grammar().define(_lisp_rules if lisp else lambda x: _vba_rules(x, full))
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    tokens = list(lisp_tokens(text) if lisp else vba_tokens(text, full))
    torn = bool(tokens) and tokens[-1][0] in ("cut", "tear", "unfinished")
    result, k = g.recognise(t for t, _ in (tokens[:-1] if torn else tokens))
    if result != "failed" and torn:
        # a comment or a string that nothing closes: to the end of the file,
        # or to the end of a line that others follow
        k = len(tokens) - 1
        result = "failed" if not lisp and "\n" in text[tokens[k][1] :].rstrip() else "truncated"
    if result == "ok":
        return "ok", None, None
    kind, at = tokens[k] if tokens else ("", 0)
    if result == "truncated":
        at = len(text)
    return result, text.count("\n", 0, at) + 1, kind if isinstance(kind, str) else " ".join(kind)


def judged(samples: DataFrame, full: bool = False) -> DataFrame:
    """(sample_id, path, input_type, result, line, token) of each source file."""
    rows = samples.select("sample_id", "path", F.lower(F.trim("input_type")).alias("input_type"), "text")
    rows = rows.where(F.col("text").isNotNull() & F.col("input_type").isin(*LANGUAGES))

    def run(it):
        for pdf in it:
            out = pdf[["sample_id", "path", "input_type"]].copy()
            got = [judge(k, t, full) for k, t in zip(pdf["input_type"], pdf["text"])]
            out["result"] = [x[0] for x in got]
            out["line"] = pd.array([x[1] for x in got], dtype="Int32")
            out["token"] = [x[2] for x in got]
            yield out

    return rows.mapInPandas(run, "sample_id string, path string, input_type string, result string, line int, token string")


def found(samples: DataFrame) -> DataFrame:
    return judged(samples).where("result <> 'ok'").select("sample_id").distinct()


def sample_path(c: Column) -> Column:
    """``eval_rows.sample`` as a path: forward slashes, no leading ``./``."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+", "")


def rates(samples: DataFrame, evals: DataFrame) -> DataFrame:
    """Invalid files per repository and language, with what the evaluations
    that name them reported.  Evaluations are counted per path before the
    join, so a sample with very many of them is one row of it."""
    files = judged(samples).groupBy("path", "input_type").agg(F.max(F.col("result") != "ok").alias("bad"), F.max(F.col("result") == "truncated").alias("cut"))
    named = evals.groupBy(F.col("sample")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("e"))
    named = named.groupBy(sample_path(F.col("sample")).alias("path")).agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    joined = files.join(named, "path", "left")
    return joined.groupBy(F.split("path", "/")[0].alias("repository"), "input_type").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("bad").alias("invalid"),
        F.count_if("cut").alias("truncated"),
        F.round(F.count_if("bad") / F.count(F.lit(1)), 6).alias("invalid_rate"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("evaluations"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("evaluation_errors"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("e"))), F.lit(0)).alias("errors_on_invalid"),
    )
