"""AutoLISP text to fact rows: nodes, effects, functions, calls, aliases.

The walk over a script is sequential (the value of a variable depends on what
ran before), so it runs once per sample inside an Arrow batch; everything
after it is relational.  A sample whose nesting passes the limit yields an
error row instead of facts, as one bad file must not stop a scan.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from triagelake.functions import vocabulary as V

_TOKEN = re.compile(
    r'(?P<note>;[^\n]*)|(?P<open>\()|(?P<close>\))|(?P<quote>\')|(?P<str>"(?:[^"\\]|\\(?s:.))*(?:"|\Z|\\\Z))'
    r"|(?P<num>-?[0-9][0-9.]*)|(?P<sym>[^() \t\r\n\";\x00]+)|(?P<skip>[\x00])"
)
_ESCAPE = re.compile(r"\\(.?)", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


@dataclass(slots=True)
class Node:
    """kind is call, list, quote, symbol, string or number."""

    kind: str
    value: object
    line: int
    kids: list = field(default_factory=list)


class TooDeep(Exception):
    pass


def _number(text: str):
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text


def parse(source: str) -> list[Node]:
    """Top-level forms; brackets that nothing closes end with the file."""
    top: list[Node] = []
    stack: list[tuple[Node, int]] = []  # open lists and quotes
    line, seen = 1, 0

    def put(n: Node) -> None:
        while True:
            if not stack:
                top.append(n)
                return
            holder = stack[-1][0]
            holder.kids.append(n)
            if holder.kind != "quote":
                return
            n = stack.pop()[0]

    def close() -> None:
        n = stack.pop()[0]
        if n.kids and n.kids[0].kind == "symbol":
            n.kind, n.value = "call", n.kids[0].value
            n.kids = n.kids[1:]
        put(n)

    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        line += source.count("\n", seen, m.start())
        seen = m.start()
        if kind in ("open", "quote"):
            if len(stack) >= V.MAX_DEPTH:
                raise TooDeep(line)
            stack.append((Node("list" if kind == "open" else "quote", None, line), 0))
        elif kind == "close":
            while stack and stack[-1][0].kind == "quote":  # a quote before nothing
                put(stack.pop()[0])
            if stack:
                close()
        elif kind == "str":
            body = text[1:-1] if len(text) > 1 and text[-1] == '"' else text[1:]
            put(Node("string", _ESCAPE.sub(lambda e: _ESCAPES.get(e.group(1), e.group(1)), body), line))
        elif kind == "num":
            put(Node("number", _number(text), line))
        elif kind == "sym":
            put(Node("symbol", text, line))
    while stack:
        if stack[-1][0].kind == "quote":
            put(stack.pop()[0])
        else:
            close()
    return top


def signature(n: Node) -> str:
    """Kind, value and number of children of a node and of its children."""
    return "|".join(f"{x.kind}:{x.value}:{len(x.kids)}" for x in (n, *n.kids))


def converge(items: list, key) -> list:
    """Of equal neighbours at most RUN_LIMIT, of equal items TOTAL_LIMIT."""
    kept, total, last, run = [], {}, None, 0
    for x in items:
        k = key(x)
        if k is None:
            continue
        run = run + 1 if k == last else 1
        last = k
        if run > V.RUN_LIMIT:
            continue
        total[k] = total.get(k, 0) + 1
        if total[k] <= V.TOTAL_LIMIT:
            kept.append(x)
    return kept


def converge_lines(source: str) -> str:
    return "\n".join(converge(source.split("\n"), lambda s: s.strip() or None))


def lift_calls(forms: list[Node]) -> list[Node]:
    """After each function definition also the calls in its parameter list,
    which hold the rest of a file whose brackets are never closed."""
    out = []
    for f in forms:
        out.append(f)
        if f.kind == "call" and str(f.value).lower() == "defun" and len(f.kids) > 1:
            todo, found = [f.kids[1]], 0
            while todo and found < V.MAX_LIFTED_CALLS:
                n = todo.pop()
                if n.kind == "call":
                    out.append(n)
                    found += 1
                todo.extend(k for k in reversed(n.kids) if k.kids or k.kind == "call")
    return out


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_TRAILING = re.compile(r"[^a-z0-9_\-:<>]+\Z")


def plain_name(name: str) -> str:
    """The function name that an operation is looked up by."""
    if name[:1] in "\"'":
        name = name[1:]
    if name[-1:] in ("\"", "'"):
        name = name[:-1]
    name = name.translate(_ASCII_LOWER)
    if len(name) > 5 and name.startswith("acad:"):
        name = name[5:]
    return _TRAILING.sub("", name.split("[", 1)[0])


@dataclass(slots=True, eq=False)
class Call:
    """A normalised call; an argument is a string, a number, a Call, a Node
    (quoted, opaque) or None."""

    op: str
    fn: str
    args: list
    line: int


def normalise(n: Node) -> Call | None:
    if n.kind != "call":
        return None
    name = str(n.value)
    return Call(V.OPERATION_OF.get(plain_name(name), "UNKNOWN") if name else "UNKNOWN", name, [_argument(k) for k in n.kids], n.line)


def _argument(n: Node):
    if n.kind in ("call", "list"):
        return normalise(n)
    if n.kind == "quote":
        return n.kids[0] if n.kids else None
    return n.value


def _printed(x) -> str:
    """Text of an opaque value, in the form that the rules look for."""
    if isinstance(x, Node):
        return f"&{{{x.kind} {x.value if x.value is not None else '<nil>'} {x.line}}}"
    if isinstance(x, Call):
        return x.fn
    return str(x)


def flat_text(args: list) -> str:
    """Lower-case text of arguments, nested calls included."""
    out, todo = [], list(reversed(args))
    while todo:
        x = todo.pop()
        if x is None or x == "":
            continue
        if isinstance(x, Call):
            todo.extend(reversed(x.args))
            x = x.fn
        elif not isinstance(x, str):
            x = _printed(x)
        x = x.lower() if isinstance(x, str) else x
        if x.strip():
            out.append(x)
    return " ".join(out).strip()


_QUOTES = "\"'"


def is_path(s: str) -> bool:
    if not s or s.startswith(("http://", "https://")):
        return False
    return "\\" in s or s.startswith(("/", "./", "../")) or ("/" in s and " / " not in s) or s.endswith(V.PATH_ENDINGS)


def is_network(fn: str, s: str) -> bool:
    if not s.startswith(("http://", "https://")):
        return False
    return any(w in fn for w in V.NETWORK_WORDS) or "?" in s or "%" in s or any(e in s for e in V.RISKY_ENDINGS)


class Walk:
    """Runs through a script once, keeps what is known of variables, and
    records effects, calls and assignments in order."""

    def __init__(self) -> None:
        self.values: dict[str, str] = {}
        self.temps = 0
        self.versions: dict[str, int] = {}
        self.scope = "__toplevel__"
        self.effects: list[tuple] = []
        self.functions: dict[str, None] = {}
        self.calls: list[tuple] = []
        self.aliases: list[tuple] = []
        self.memo: dict[int, tuple[int, str]] = {}
        self.version = 0

    # -- values

    def know(self, name: str, value: str) -> None:
        if name and self.values.get(name) != value:
            self.values[name] = value
            self.version += 1

    def clean(self, raw) -> str:
        if raw is None:
            return "unknown"
        if isinstance(raw, float):
            raw = repr(raw).removesuffix(".0")
        raw = raw if isinstance(raw, str) else _printed(raw)
        s = self.values.get(raw, raw).strip().strip('"').strip("'")
        s = " ".join(s.split("[", 1)[0].split())
        return s or "unknown"

    def text_of(self, x) -> str:
        """Best known string value of an expression."""
        if isinstance(x, str):
            return self.values.get(x, x)
        if isinstance(x, (int, float)):
            return str(int(x))
        if x is None:
            return ""
        if not isinstance(x, Call):
            s = _printed(x)
            return self.values.get(s, s)
        held = self.memo.get(id(x))
        if held and held[0] == self.version:
            return held[1]
        fn, out = x.fn.lower(), ""
        first = x.args[0] if x.args else None
        if fn == "strcat":
            out = "".join(self.text_of(a) for a in x.args)
            self.memo[id(x)] = (self.version, out)
            return out
        if fn == "chr":
            code = self.values.get(first, first) if isinstance(first, str) else first
            try:
                out = chr(int(code)) if code is not None and not isinstance(code, (Call, Node)) else ""
            except (ValueError, OverflowError):
                out = ""
        elif fn == "strcase":
            out = self.text_of(first).upper() if x.args else ""
        elif fn == "substr":
            # the third argument counts as an absolute end
            if len(x.args) >= 3:
                s = self.text_of(first)
                start = x.args[1] - 1 if isinstance(x.args[1], int) else 0
                end = x.args[2] if isinstance(x.args[2], int) else len(s)
                if 0 <= start < len(s) and start < end <= len(s):
                    out = s[start:end]
        elif x.fn in self.values:
            out = self.values[x.fn]
        elif isinstance(first, str):
            out = first
        out = out or x.fn
        self.memo[id(x)] = (self.version, out)
        return out

    def target(self, args: list, k: int) -> str:
        """The target that argument ``k`` stands for."""
        if not args or k >= len(args):
            return ""
        x = args[k]
        if x is None:
            return ""
        if isinstance(x, str):
            return self.clean(self.values[x]) if x in self.values else x
        if isinstance(x, Call):
            s = self.text_of(x)
            if s and s != x.fn:
                return self.clean(s)
            if x.args and isinstance(x.args[0], str):
                return self.clean(self.text_of(x.args[0])) if self.text_of(x.args[0]) else x.args[0]
            return x.fn
        s = _printed(x)
        return self.values.get(s, s)

    # -- statements

    def run(self, calls: list[Call]) -> None:
        for c in calls:
            self.scope = "__toplevel__"
            self.visit(c)

    def visit(self, c: Call) -> str:
        if c.op == "DEFUN":
            return self.define(c)
        if c.op == "SETQ":
            return self.assign(c)
        if c.op in ("IF", "WHILE"):
            if len(c.args) < 2:
                return ""
            parts = c.args[: 3 if c.op == "IF" else 2]
            results = [self.visit(p) if isinstance(p, Call) else "" for p in parts]
            self.functions.setdefault(self.scope)
            return results[0]
        return self.call(c)

    def define(self, c: Call) -> str:
        name = c.args[0] if c.args and isinstance(c.args[0], str) else "anonymous"
        outer, self.scope = self.scope, name
        self.functions.setdefault(name)
        for body in c.args[2:]:
            if isinstance(body, Call):
                self.visit(body)
        self.scope = outer
        return name

    def assign(self, c: Call) -> str:
        if len(c.args) < 2:
            return ""
        name = c.args[0] if isinstance(c.args[0], str) else ""
        value = known = ""
        if isinstance(c.args[1], Call):
            value = self.visit(c.args[1])
            known = self.text_of(c.args[1])
        elif isinstance(c.args[1], str):
            value = known = c.args[1]
        version = self.versions.get(name, 0)
        self.versions[name] = version + 1
        result = f"{name}_{version}"
        tracked = known if known and known != value else self.values.get(value, value)
        self.know(name, tracked)
        self.know(result, tracked)
        self.functions.setdefault(self.scope)
        last = next((v for v in (value, name) if v), "")
        if last and last != result:
            self.aliases.append((self.scope, result, last))
        return result

    def call(self, c: Call) -> str:
        result = f"t{self.temps}"
        self.temps += 1
        operands = [self.visit(a) if isinstance(a, Call) else a for a in c.args]
        self.know(result, result)
        self.functions.setdefault(self.scope)
        self.calls.append((self.scope, c.fn, c.line))
        self.observe(c)
        if c.op == "FILE_OPEN" and c.args:
            at = self.target(c.args, 0)
            if at and at != "unknown":
                self.know(result, self.clean(at))
        elif c.op == "COM_CREATE" and operands:
            self.know(result, self.clean(operands[0]))
        elif c.fn.lower() in ("strcat", "vl-string-subst"):
            parts = [self.clean(self.values.get(o) or o) for o in operands if isinstance(o, str)]
            if parts:
                self.know(result, "".join(parts))
        return result

    # -- effects

    def effect(self, kind: str, target: str, source: str, line: int, meta: dict) -> None:
        self.effects.append((self.scope, kind, target, source, {k: str(v) for k, v in meta.items()}, line))

    def observe(self, c: Call) -> None:
        fn = c.fn.lower()
        first = c.args[0] if c.args else None
        own = first if isinstance(first, str) else ""
        kind = V.EFFECT_OF.get(c.op)
        meta: dict = {}
        if c.op == "UNKNOWN":
            self.infer(c, fn)
            return
        if c.op == "CAD_COMMAND":
            head = self.clean(first).lower() if c.args else ""
            if fn != "command" or not c.args or not (head in V.HIJACK_WORDS or "undefine" in head):
                return
            kind, meta["hijack_type"] = "command_hijack", "undefine"
            own = c.args[1] if len(c.args) > 1 and isinstance(c.args[1], str) else ""
        elif c.op in ("FILE_WRITE", "FILE_OPEN"):
            if fn in ("princ", "print") and len(c.args) < 2:
                return  # to the command line, not to a file
            wide = fn in ("write-line", "write-char", "princ", "print") and len(c.args) >= 2
            own = self.target(c.args, len(c.args) - 1 if wide else 0)
            if c.op == "FILE_WRITE" and c.args:
                meta["target"] = self.clean(first)
            if fn == "vl-file-copy" and len(c.args) >= 2:
                origin, copy = self.target(c.args, 0), self.target(c.args, 1)
                if origin not in ("", "unknown"):
                    self.effect("file_read", self.clean(origin), c.fn, c.line, meta)
                if copy not in ("", "unknown"):
                    own = copy
        elif c.op in ("FILE_READ", "LOAD"):
            own = self.target(c.args, 0)
            if c.op == "LOAD":
                meta["code_load"] = "true"
        elif c.op == "EVAL":
            own = ""
        if kind:
            self.effect(kind, self.clean(own), c.fn, c.line, meta)

    def infer(self, c: Call, fn: str) -> None:
        """Effects that the arguments of an unknown function suggest."""
        args = [self.clean(a) for a in c.args if isinstance(a, str)]
        low = [a.lower() for a in args]
        sure = {"inferred_from": "unknown_call_args", "confidence": 0.5}
        for a, x in zip(args, low):
            if "hkey_" in x:
                self.effect("registry_modify", a, c.fn, c.line, sure)
        joined = " ".join(low)
        if any(w in joined for w in V.COMMAND_WORDS):
            command = next((a for a, x in zip(args, low) if any(w in x for w in V.COMMAND_WORDS)), "unknown")
            self.effect("process_create", command, c.fn, c.line, sure)
            if "attrib" in joined and "+h" in joined:
                self.effect("file_hidden", command, c.fn, c.line, sure)
        for a, x in zip(args, low):
            if is_network(fn, x):
                self.effect("network_connect", a, c.fn, c.line, sure)
                break
        urls = [a for a, x in zip(args, low) if x.startswith(("http://", "https://"))]
        paths = [a for a, x in zip(args, low) if is_path(x) and "hkey_" not in x and not any(w in x for w in V.COMMAND_WORDS)]
        if len(paths) >= 2 and (any(w in fn for w in V.WRITE_WORDS) or is_path(paths[-1].lower()) and is_path(paths[0].lower())):
            self.effect("file_write", paths[-1], c.fn, c.line, {"content": paths[0], **sure})
        elif urls and paths:
            self.effect("network_connect", urls[0], c.fn, c.line, sure)
            self.effect("file_write", paths[-1], c.fn, c.line, {"content": urls[0], **sure})


def script_facts(source: str):
    """(nodes, effects, functions, calls, aliases) of one script."""
    forms = converge(lift_calls(parse(converge_lines(source))), signature)
    calls = [c for c in map(normalise, forms) if c is not None]
    w = Walk()
    w.run(calls)
    return calls, w


FACTS = (
    "sample_id string, fact string, seq int, fn string, name string, target string, source string, line int, "
    "depth int, parent int, meta map<string,string>, args array<struct<kind:string,text:string,num:double,child:int>>"
)
_COLUMNS = [c.split()[0] for c in re.sub(r"<[^,]*?>|array<.*>", "", FACTS).split(", ")]


def _rows(sample_id: str, source: str):
    calls, w = script_facts(source)
    out = []

    def row(fact, seq, **x):
        out.append((sample_id, fact, seq, x.get("fn"), x.get("name"), x.get("target"), x.get("source"), x.get("line"), x.get("depth"), x.get("parent"), x.get("meta"), x.get("args")))

    number = 0
    for k, top in enumerate(calls):
        todo = [(top, None, 0)]
        numbers: dict[int, int] = {}
        while todo:
            c, parent, depth = todo.pop()
            me = numbers.get(id(c))
            if me is None:
                me, number = number, number + 1
            args = []
            for a in c.args:
                if isinstance(a, Call):
                    numbers[id(a)] = number
                    args.append({"kind": "call", "text": a.fn, "num": None, "child": number})
                    todo.append((a, me, depth + 1))
                    number += 1
                elif isinstance(a, str):
                    args.append({"kind": "text", "text": a, "num": None, "child": None})
                elif isinstance(a, (int, float)):
                    args.append({"kind": "number", "text": None, "num": float(a), "child": None})
                else:
                    args.append({"kind": "nil" if a is None else "quote", "text": None if a is None else _printed(a), "num": None, "child": None})
            whole = None
            if depth == 0:
                whole = (c.fn.lower() + " " + flat_text(c.args)).strip()
            row("node", me, fn=c.fn, name=c.op, line=c.line, depth=depth, parent=parent, args=args, source=whole, target=str(k) if depth == 0 else None)
    for k, (scope, kind, target, src, meta, line) in enumerate(w.effects):
        row("effect", k, fn=scope, name=kind, target=target, source=src, line=line, meta=meta)
    for k, fn in enumerate(w.functions):
        row("function", k, fn=fn)
    for k, (scope, fn, line) in enumerate(w.calls):
        row("call", k, fn=scope, name=fn, line=line)
    for k, (scope, name, value) in enumerate(w.aliases):
        row("alias", k, fn=scope, name=name, target=value)
    return out


def facts(samples: DataFrame, key: str = "sample_id", text: str = "text") -> DataFrame:
    """Fact rows of all samples with a text; one row per fact, ``fact`` tells
    which.  Null texts give no rows, a text that can't be read an error row."""

    def run(it):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * V.MAX_DEPTH))
        for pdf in it:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                try:
                    rows.extend(_rows(k, t.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")))
                except (TooDeep, RecursionError) as e:
                    rows.append((k, "error", 0, None, type(e).__name__) + (None,) * 7)
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return samples.selectExpr(f"`{key}` as k", f"cast(`{text}` as string) as t").where("t is not null").mapInPandas(run, FACTS)


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("seq", "line", "depth", "parent"):
        frame[c] = frame[c].astype("Int32")
    return frame
