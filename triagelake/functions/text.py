"""Text clean-up, sniffing and extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import vocabulary as V

# fixed values: functions that a line of source may start with
KNOWN_HEADS = (
    "setq", "defun", "if", "while", "open", "close", "write-line", "read-line", "strcat", "findfile", "load", "vl-",
    "progn", "and", "or", "not", "foreach", "repeat", "princ", "command",
)
HEAD = r"(?md)^[ \t\r]*\((?:" + "|".join(KNOWN_HEADS) + ")"
SNIFF_HEADER, SNIFF_SOURCE, SNIFF_VBA = 4 * 1024, 64 * 1024, 256 * 1024


def strip_comments(text: Column) -> Column:
    """Cut each line at its first semicolon, also inside a string, and at the
    blanks before it."""
    return F.regexp_replace(text, r"(?md)[ \t\r]*(?:;[^\n]*)?$", "")


def drop_preamble(text: Column) -> Column:
    """From the first line that starts with a known call; else unchanged."""
    at = F.regexp_instr(text, F.lit(HEAD))
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)


def has_compiled_header(text: Column) -> Column:
    return F.substring(text, 1, SNIFF_HEADER).rlike(r"(?m)^[ \t\r]*(?:FAS4|; AutoCAD Binary File)")


def looks_like_source(text: Column) -> Column:
    return F.substring(text, 1, SNIFF_SOURCE).rlike(HEAD)


# fixed values: patterns that speak for one of the two languages
VBA_SIGNS = (
    r"\bSub\s+\w+\s*\(", r"\bEnd\s+Sub\b", r"\bPrivate\s+Sub\b", r"\bPublic\s+Sub\b", r"\bFunction\s+\w+\s*\(",
    r"\bDim\s+\w+\s+As\b", r"\bSet\s+\w+\s*=\s*\w+", r"\bCreateObject\s*\(", r"\bGetObject\s*\(",
)
LISP_SIGNS = (r"\(\s*defun\b", r"\(\s*setq\b", r"\(\s*command\b", r"\(\s*if\b")


def _signs(text: Column, patterns) -> Column:
    return sum((text.rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0))


def is_vba(text: Column) -> Column:
    head = F.substring(text, 1, SNIFF_VBA)
    n = _signs(head, VBA_SIGNS)
    return F.coalesce((n >= 2) & (n > _signs(head, LISP_SIGNS)), F.lit(False))


# fixed values: what a macro does, by pattern
VBA_BEHAVIOURS = {
    "shell": r'\bShell\s+"([^"]+)"|\bShell\s+([^\n,]+)',
    "com_object": r'(?:CreateObject|GetObject)\s*\(\s*["\']?\s*"?([^"(),\s]+)"?',
    "file_write": r'\bOpen\s+"([^"]+)"\s+For\s+Output',
    "file_read": r'\bOpen\s+"([^"]+)"\s+For\s+Input',
    "registry": r'(HKEY_[A-Z_]+\\[^\n"]+)',
    "url": r"""https?://[^\s"'()]+""",
    "hook": r"Private\s+Sub\s+(AcadDocument_\w+|ACADApp_\w+)\s*\(",
    "template": r"\.dwt\b|acad\.dwt|acadiso\.dwt",
    "autoload": r"acaddoc\.lsp",
    "undefine": r"""command\s+["']undefine["']\s*,?\s*["']([^"']+)["']""",
    "wmi": r"winmgmts|WMIobj|SELECT\s+\*\s+FROM\s+\w+",
    "mac": r"MACAddress|NetConnectionID",
    "save_as": r"\.SaveAs\b",
    "inject": r"InsertLines|AddFromString|CodeModule",
}
# fixed values: a template named in a macro, and the longest registry key kept
VBA_TEMPLATE_PATH = r'"([^"]*\.dwt)"'
VBA_KEY_LENGTH = 120
# fixed values: of these kinds only the first few are translated
VBA_LIMITS = {"registry": 8, "file_write": 8, "file_read": 4, "url": 4, "target": 4, "undefine": 8}


def _found(text: Column, kind: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit("(?i)" + VBA_BEHAVIOURS[kind]), F.lit(group))


def vba_found(text: Column) -> dict[str, Column]:
    """What a macro does: an array of values per kind, in order."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), '^"+|"+$', "")
    shell = F.transform(F.filter(F.arrays_zip(_found(text, "shell", 1).alias("q"), _found(text, "shell", 2).alias("b")), lambda x: x.isNotNull()), lambda x: bare(F.coalesce(F.nullif(x["q"], F.lit("")), x["b"])))
    out = {
        "shell": F.filter(shell, lambda x: x != ""),
        "com_object": F.transform(_found(text, "com_object", 1), F.lower),
        **{k: _found(text, k, 1) for k in ("file_write", "file_read", "hook", "undefine")},
        "registry": F.transform(_found(text, "registry", 1), lambda x: F.left(x, F.lit(VBA_KEY_LENGTH))),
        **{k: _found(text, k) for k in ("url", "template", "autoload", "wmi", "mac", "save_as", "inject")},
    }
    templates = F.when(F.size(out["template"]) > 0, F.regexp_extract_all(text, F.lit(VBA_TEMPLATE_PATH), F.lit(1))).otherwise(F.array().cast("array<string>"))
    out["target"] = F.concat(templates, F.slice(F.transform(out["autoload"], lambda _: F.lit("acaddoc.lsp")), 1, 1))
    return out


def vba_behaviours(samples: DataFrame, key: str = "sample_id", text: str = "text") -> DataFrame:
    """``(sample_id, kind, pos, value)`` of what macro sources do."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("found")) for k, v in vba_found(F.col(text)).items()])
    rows = samples.where(F.col(text).isNotNull()).select(key, F.explode(each).alias("b"))
    return rows.select(key, "b.kind", F.posexplode("b.found").alias("pos", "value")).where("value <> ''")


# fixed values: script lines that stand for a macro's behaviours; {} is the value
VBA_HOOK_LINES = (
    "  (vlr-dwg-reactor nil (list (cons :vlr-beginClose (function vba-payload))))",
    "  (vlr-dwg-reactor nil (list (cons :vlr-saveComplete (function vba-payload))))",
)
VBA_COM_LINE = '  (vlax-create-object "{}")'
VBA_SHELL_LINE = '  (command "shell" "{}")'
VBA_REGEDIT_LINE = r'  (vl-registry-write "HKEY_CURRENT_USER\\Software\\Autodesk" "AutoEmbedding" 1)'
VBA_REGISTRY_LINE = '  (vl-registry-write "{}" "value" 1)'
VBA_WRITE_LINES = '  (setq _f (open "{}" "w"))\n  (close _f)'
VBA_READ_LINES = '  (setq _f (open "{}" "r"))\n  (close _f)'
VBA_URL_LINE = '  (vlax-invoke-method _http "Open" "GET" "{}" nil)'
VBA_WMI_LINES = ('  (vlax-create-object "WbemScripting.SWbemLocator")', '  (vlax-invoke-method _wmi "ExecQuery" "SELECT * FROM Win32_NetworkAdapter")')
VBA_SPREAD_LINE = '  (vl-file-copy (findfile "acaddoc.lsp") (strcat (getvar "roamablerootprefix") "acaddoc.lsp"))'
VBA_TARGET_LINE = '  (vl-file-copy _src "{}")'
VBA_UNDEFINE_LINE = '  (command "undefine" "{}")'
VBA_INJECT_LINES = (
    '  (setq _doc (vlax-get-property (vlax-get-acad-object) "ActiveDocument"))',
    '  (setq _vbe (vlax-get-property _doc "VBProject"))',
    '  (setq _code (vlax-get-property _vbe "CodeModule"))',
    '  (vlax-invoke-method _code "InsertLines" 1 "(setq flag t)")',
    r'  (vlax-invoke-method _code "AddFromString" "(load \"acaddoc.lsp\")")',
)
VBA_PAYLOAD_LINES = ('  (setq _src (findfile "acaddoc.lsp"))', '  (vl-file-copy _src (strcat (getvar "roamablerootprefix") "acaddoc.lsp"))')


def macro_script(text: Column) -> Column:
    """A script that does what a macro does, so that one front end reads both.

    Start-up holds a line per behaviour, the first few of some kinds; hooks
    call a payload of their own.
    """
    found = vba_found(text)

    def lines(kind: str, line: str) -> Column:
        some = F.slice(found[kind], 1, VBA_LIMITS[kind]) if kind in VBA_LIMITS else found[kind]
        before, after = line.split("{}")
        return F.transform(some, lambda x: F.concat(F.lit(before), escape(x), F.lit(after)))

    fixed = lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<string>")
    given = lambda c, *x: F.when(c, fixed(*x)).otherwise(none)
    some = lambda k: F.size(found[k]) > 0
    hooks = F.flatten(F.transform(F.filter(found["hook"], lambda h: F.lower(h).rlike("beginclose|activate")), lambda _: fixed(*VBA_HOOK_LINES)))
    before, after = VBA_SHELL_LINE.split("{}")
    shell = F.flatten(F.transform(found["shell"], lambda x: F.concat(F.array(F.concat(F.lit(before), escape(x), F.lit(after))), given(F.lower(x).contains("regedit"), VBA_REGEDIT_LINE))))
    infects = some("template") | some("save_as")
    body = F.concat(
        fixed("(defun s::startup ()"), hooks, lines("com_object", VBA_COM_LINE), shell, lines("registry", VBA_REGISTRY_LINE), lines("file_write", VBA_WRITE_LINES), lines("file_read", VBA_READ_LINES),
        lines("url", VBA_URL_LINE), given(some("mac") | some("wmi"), *VBA_WMI_LINES), F.when(infects, F.concat(fixed(VBA_SPREAD_LINE), lines("target", VBA_TARGET_LINE))).otherwise(none),
        lines("undefine", VBA_UNDEFINE_LINE), given(some("inject"), *VBA_INJECT_LINES, VBA_SPREAD_LINE), fixed(")"),
        F.when(some("hook"), F.concat(fixed("(defun vba-payload (/ _src _dst)"), given(infects, *VBA_PAYLOAD_LINES), lines("target", VBA_TARGET_LINE), fixed(")"))).otherwise(none),
    )
    return F.array_join(body, "\n")


def line_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank lines of texts with their positions."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.withColumn("k", F.regexp_replace("line", r"^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$", "")).where("k <> ''")


def converge_rows(rows: DataFrame, key: str, order: str, what: str, run_limit: int = V.RUN_LIMIT, total_limit: int = V.TOTAL_LIMIT) -> DataFrame:
    """Of equal neighbours at most ``run_limit``, of equal items at most
    ``total_limit``, per key and in order (gaps and islands).

    The first two windows are over one text; the third is over one item of a
    text, so a line that is repeated without end is ranked, not collected.
    """
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce(F.lag(what).over(w) != F.col(what), F.lit(True)).cast("int")
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("_in_run", F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))).where(F.col("_in_run") <= run_limit)
    ranked = runs.withColumn("_nth", F.row_number().over(Window.partitionBy(key, what).orderBy(order)))
    return ranked.where(F.col("_nth") <= total_limit).drop("_new", "_run", "_in_run", "_nth")


def decoded_runs(rows: DataFrame, key: str, order: str, is_code: Column, code: Column, least: int = 3) -> DataFrame:
    """Texts spelled by runs of character codes among ordered rows."""
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("_c", is_code).withColumn("_g", F.sum((~F.col("_c")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = r.where(F.col("_c") & code.isNotNull()).withColumn("_code", code)
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_code").alias("c"))))
    runs = told.groupBy(key, "_g").agg(items.alias("v"), F.min(order).alias("start")).where(F.size("v") >= least)
    chars = F.transform(F.filter("v", lambda x: (x["c"] >= 32) & (x["c"] <= 126)), lambda x: F.char(x["c"]))
    return runs.select(key, "start", F.size("v").alias("codes"), F.array_join(chars, "").alias("decoded"))


def printable_runs(text: Column, least: int = 4, most: int = 256) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([ -~]{{{least},{most}}})"), F.lit(1))


def escape(text: Column) -> Column:
    """Backslashes and quotes escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def character(code: Column) -> Column:
    """Character of a code point, also beyond Latin-1."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def int_prefix(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")), F.lit("S999999999999999999")).cast("bigint")
