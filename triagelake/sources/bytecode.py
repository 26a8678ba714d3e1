"""Bytecode of compiled files to rows: instructions, frames, calls, edges.

Instructions are decoded in Arrow batches.  Frames open and close in order,
so the owner of an instruction comes from the same pass; what follows (block
edges, bindings, behaviours) is relational.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators.effects import any_in

# fixed values: instruction names by layout of what follows the code byte
LAYOUTS = {
    "": {
        0x00: "NOP", 0x01: "PUSH_NIL", 0x02: "PUSH_T", 0x0A: "POP", 0x0B: "DUP", 0x16: "END_DEFUN", 0x17: "MAIN",
        0x1C: "COPY_STACK", 0x20: "NOP", 0x23: "NULL_P", 0x24: "ATOM_P", 0x26: "SUB", 0x28: "CAR", 0x29: "CDR",
        0x2A: "CONS", 0x38: "CONVERT", 0x3E: "EXIT_IF_NZ", 0x3F: "EXIT_IF_Z", 0x46: "ADD_FIXNUM", 0x47: "SUB_FIXNUM",
        0x48: "MUL_FIXNUM", 0x49: "DIV_FIXNUM", 0x4A: "MOD_FIXNUM", 0x4B: "LE_FIXNUM", 0x4C: "GE_FIXNUM",
        0x4D: "LT_FIXNUM", 0x4E: "GT_FIXNUM", 0x4F: "INC1", 0x50: "DEC1", 0x62: "NOP", 0x63: "NOP",
    },
    "B": {
        0x08: "SETQ_LVAR8", 0x1E: "ALPHA", 0x1F: "BETA", 0x25: "IS_SYM", 0x2C: "LIST_IDX", 0x2D: "LIST_SET",
        0x2E: "STACK_CALL_JMP", 0x32: "SETQ", 0x34: "EVAL", 0x64: "CLEAR_LVAR8",
    },
    "H": {
        0x03: "PUSH_SYM", 0x05: "LOAD_LVAR", 0x06: "SETQ_GVAR", 0x09: "PUSH_CONST", 0x0C: "PUSH_GVAR",
        0x10: "LIST_STEP", 0x11: "OP_11", 0x12: "OP_12", 0x18: "INIT_ARGS", 0x19: "CLEAR_ARGS", 0x1A: "SETQ_DEFUN",
        0x1B: "SETQ_FSL", 0x21: "END_DEFUN2", 0x37: "MAKE_LIST", 0x39: "LD_LIST", 0x5C: "LOAD_LVAR2",
        0x5D: "SETQ_LVAR", 0x5E: "CLEAR_LVAR",
    },
    "h": {0x0D: "BR_IF_FALSE", 0x0E: "BR_IF_TRUE", 0x0F: "JMP", 0x3C: "BR_IF_FALSE2", 0x3D: "BR_IF_TRUE2"},
    "i": {
        0x33: "PUSH_INT32", 0x57: "JMP_FAR", 0x67: "BR_IF_TRUE_FAR", 0x68: "OR_JMP", 0x69: "BR2_IF_TRUE_FAR",
        0x6A: "AND_JMP",
    },
    "frame": {0x14: "DEFUN", 0x15: "DEFUN_Q"},
    "call": {0x35: "CALL"},
    "func": {0x51: "FUNC"},
    "jump": {0x2F: "CALL_JMP"},
    "far": {0x5F: "CALL_BY_OFFSET"},
}
# fixed values: bytes after the code byte
SIZES = {"": 0, "B": 1, "H": 2, "h": 2, "i": 4, "frame": 4, "call": 4, "func": 5, "jump": 3, "far": 5}
OPCODES = {code: (name, layout) for layout, names in LAYOUTS.items() for code, name in names.items()}
BRANCHES = ("BR_IF_FALSE", "BR_IF_TRUE", "BR_IF_FALSE2", "BR_IF_TRUE2", "BR_IF_TRUE_FAR", "BR2_IF_TRUE_FAR", "AND_JMP", "OR_JMP")
JUMPS = ("JMP", "JMP_FAR")
FRAMES = ("DEFUN", "DEFUN_Q", "FUNC", "MAIN")
ENDS = ("END_DEFUN", "END_DEFUN2")
CALLS = ("CALL", "CALL_JMP")


def disassemble(code: bytes) -> list[tuple[int, str, list[int], int]]:
    """(offset, name, operands, size); unknown codes take one byte.

    The first four bytes are a header.  A last instruction whose operands are
    cut off is left out.
    """
    out = []
    at, n = 4, len(code)
    word = lambda p, k, signed=False: int.from_bytes(code[p : p + k], "little", signed=signed)
    while at < n:
        known = OPCODES.get(code[at])
        if known is None:
            out.append((at, f"UNKNOWN_{code[at]:02X}", [], 1))
            at += 1
            continue
        name, layout = known
        size = SIZES[layout]
        if at + size >= n and size:
            break
        p = at + 1
        if layout in ("B", "H"):
            ops = [word(p, size)]
        elif layout in ("h", "i"):
            ops = [word(p, size, True)]
        elif layout == "frame":
            ops = [((code[p + 3] & 0xFE) << 7) | code[p], code[p + 1], code[p + 2], code[p + 3] & 1]
        elif layout in ("call", "func"):
            ops = [code[p], word(p + 1, 2), code[p + 3]]
        elif layout == "jump":
            ops = [code[p], word(p + 1, 2)]
        elif layout == "far":
            ops = [code[p], word(p + 1, 4, True)]
        else:
            ops = []
        out.append((at, name, ops, size + 1))
        at += size + 1
    return out


INSTRUCTIONS = "sample_id string, seq int, position int, name string, operands array<int>, size int, frame int, text string"


def instructions(files: DataFrame, key: str = "sample_id") -> DataFrame:
    """Instruction rows of ``files(sample_id, code, symbols, strings)``.

    ``frame`` is the offset at which the innermost open function starts (null
    outside); ``text`` the symbol or string that an index names.
    """

    def run(it):
        for pdf in it:
            rows = []
            for k, code, symbols, strings in zip(pdf["k"], pdf["code"], pdf["symbols"], pdf["strings"]):
                if code is None:
                    continue
                open_: list[int] = []
                for seq, (at, name, ops, size) in enumerate(disassemble(bytes(code))):
                    if name in FRAMES:
                        open_.append(at)
                    text = None
                    pool = strings if name == "PUSH_CONST" else symbols if name in ("PUSH_SYM", "PUSH_GVAR", "SETQ_GVAR", "SETQ_DEFUN", *CALLS, "FUNC") else None
                    if pool is not None and ops:
                        i = ops[1] if name in (*CALLS, "FUNC") else ops[0]
                        text = pool[i] if 0 <= i < len(pool) else None
                    rows.append((k, seq, at, name, ops, size, open_[-1] if open_ else None, text))
                    if name in ENDS and open_:
                        open_.pop()
            frame = pd.DataFrame(rows, columns=["sample_id", "seq", "position", "name", "operands", "size", "frame", "text"])
            frame["frame"] = frame["frame"].astype("Int32")
            yield frame

    return files.selectExpr(f"`{key}` as k", "code", "symbols", "strings").mapInPandas(run, INSTRUCTIONS)


def frames(instr: DataFrame) -> DataFrame:
    """Functions: arguments, most arguments, locals and frame size, calls."""
    op = lambda i: F.get("operands", i)
    heads = instr.where(F.col("name").isin(*FRAMES)).select(
        "sample_id", F.col("position").alias("frame"), F.col("name").alias("kind"),
        F.when(F.col("name").isin("DEFUN", "DEFUN_Q"), op(1)).when(F.col("name") == "FUNC", op(0)).otherwise(0).alias("num_args"),
        F.when(F.col("name").isin("DEFUN", "DEFUN_Q"), op(2)).when(F.col("name") == "FUNC", op(0)).otherwise(0).alias("max_args"),
        F.when(F.col("name").isin("DEFUN", "DEFUN_Q"), op(0)).otherwise(0).alias("vars"),
    )
    inside = instr.where("frame is not null").groupBy("sample_id", "frame").agg(
        F.max(F.col("position") + F.col("size") - 1).alias("end"),
        F.count(F.lit(1)).alias("instructions"),
        F.array_sort(F.collect_set(F.when(F.col("name").isin(*CALLS), F.col("text")))).alias("calls"),
        F.count_if(F.col("name").isin("STACK_CALL_JMP", "EVAL", "CALL_BY_OFFSET")).alias("indirect"),
        F.max(F.when(F.col("name") == "INIT_ARGS", op(0))).alias("frame_size"),
    )
    out = heads.join(inside, ["sample_id", "frame"])
    return out.withColumn("locals", F.greatest(F.coalesce("frame_size", "vars") - F.col("num_args"), F.lit(0)))


def owners(instr: DataFrame, bounds: DataFrame) -> DataFrame:
    """Owner of each instruction by bounds alone: of the functions whose span
    holds it, the one that starts last.

    A range join on the sample key; ``bounds(sample_id, frame, end)``.
    """
    b = bounds.select(F.col("sample_id").alias("_k"), F.col("frame").alias("owner"), F.col("end").alias("_end"))
    hit = instr.join(b, (F.col("sample_id") == F.col("_k")) & F.col("position").between(F.col("owner"), F.col("_end")), "left")
    return hit.groupBy("sample_id", "seq", "position").agg(F.max("owner").alias("owner"))


def edges(instr: DataFrame) -> DataFrame:
    """Control edges (from, to, kind), with the fall-through of conditions."""
    n, after = F.col("name"), F.col("position") + F.col("size")
    target = after + F.get("operands", 0)
    each = F.array_compact(
        F.array(
            F.when(n.isin(*BRANCHES, *JUMPS), F.struct(target.alias("dst"), n.alias("kind"))),
            F.when(n.isin(*BRANCHES), F.struct(after.alias("dst"), F.lit("fallthrough").alias("kind"))),
        )
    )
    return instr.select("sample_id", F.col("position").alias("src"), F.explode(each).alias("e")).select("sample_id", "src", "e.*").distinct()


def block_starts(instr: DataFrame) -> DataFrame:
    """Offsets at which a basic block starts."""
    heads = instr.where(F.col("name").isin(*FRAMES)).select("sample_id", "position")
    return heads.unionByName(edges(instr).select("sample_id", F.col("dst").alias("position"))).distinct()


def bindings(instr: DataFrame) -> DataFrame:
    """Last value bound to each global and to each slot of a function, as the
    literal pushed right before it."""
    w = Window.partitionBy("sample_id").orderBy("seq")
    literal = F.when(F.lag("name").over(w) == "PUSH_CONST", F.lag("text").over(w)).when(F.lag("name").over(w) == "PUSH_INT32", F.lag(F.get("operands", 0)).over(w).cast("string"))
    marked = instr.withColumn("value", literal)
    scope = F.when(F.col("name").isin("SETQ_GVAR", "SETQ_DEFUN"), F.lit(-1)).when(F.col("name").isin("SETQ", "SETQ_LVAR", "SETQ_LVAR8"), F.coalesce("frame", F.lit(-1)))
    sets = marked.withColumn("scope", scope).where("scope is not null and value is not null")
    return sets.groupBy("sample_id", "scope", F.get("operands", 0).alias("slot")).agg(
        F.max_by("value", "seq").alias("value"), F.max_by("text", "seq").alias("symbol"), F.max("position").alias("position")
    )


def resource_class(value: Column) -> Column:
    """Classes of indicators that a recovered string belongs to."""
    v, low = value, F.lower(value)
    slashes = F.length(v) - F.length(F.replace(v, F.lit("\\"), F.lit("")))
    return F.array_compact(
        F.array(
            F.when(low.rlike(r"^https?://[^\s\"']+"), F.lit("url")),
            F.when(low.contains("hkey_") & (slashes >= 1), F.lit("registry_key")),
            F.when(any_in(low, ("wscript", "scripting.", "microsoft.xml", "msxml", "adodb", "scriptlet", "wbemscripting", "shell.application", "winhttp", "xmlhttp")), F.lit("com_object")),
            F.when(any_in(low, ("cmd.exe", "rundll32", "regsvr32", "wscript.exe", "powershell", "mshta", "certutil", "bitsadmin", "attrib ")), F.lit("command")),
            F.when(low.rlike(r"\.(lsp|fas|vlx|mnl|dcl|scr|dll|ocx|exe)\b"), F.lit("file_path")),
            F.when(v.contains("\\") | v.contains("/"), F.lit("path")),
            F.when(low.contains(".") & ~v.startswith("[") & (F.length(v) > 3), F.lit("filename")),
            F.when(v.rlike(r"^\[(S::|VLR)"), F.lit("reactor")),
        )
    )


def resource_summary(resources: DataFrame) -> DataFrame:
    """Indicators per file and class."""
    rows = resources.where("value is not null").select("sample_id", "idx", "value", F.explode(resource_class(F.col("value"))).alias("class"))
    return rows.select("sample_id", "class", "idx", "value").distinct()


# fixed values: effects that a recovered indicator stands for, and how many
SUMMARY_EFFECTS = {"url": ("network_connect", 8), "com_object": ("com_create", 4), "registry_key": ("registry_modify", 4), "command": ("process_create", 4), "file_path": ("file_write", 6)}


def summary_effects(summary: DataFrame) -> DataFrame:
    """Effects from recovered indicators: each different value (regardless of
    case) once, the first few of a class; too many addresses give none."""
    w = Window.partitionBy("sample_id", "class")
    once = summary.where(F.col("class").isin(*SUMMARY_EFFECTS)).groupBy("sample_id", "class", F.lower("value").alias("low")).agg(F.min_by("value", "idx").alias("value"), F.min("idx").alias("idx"))
    ranked = once.withColumn("k", F.row_number().over(w.orderBy("idx"))).withColumn("n", F.count(F.lit(1)).over(w))
    limit = F.create_map(*[x for c, (_, n) in SUMMARY_EFFECTS.items() for x in (F.lit(c), F.lit(n))])
    kind = F.create_map(*[x for c, (e, _) in SUMMARY_EFFECTS.items() for x in (F.lit(c), F.lit(e))])
    kept = ranked.where((F.col("k") <= limit[F.col("class")]) & ((F.col("class") != "url") | (F.col("n") <= 8)))
    return kept.select(
        "sample_id", F.col("idx").alias("seq"), F.lit("recovered_fas_module").alias("fn"), kind[F.col("class")].alias("effect_type"), F.col("value").alias("target"),
        F.lit("recovered_fas_module").alias("source"), F.create_map(F.lit("recovered_from"), F.lit("resource_summary"), F.lit("summary_field"), F.col("class")).alias("meta"), F.lit(None).cast("int").alias("line"),
    )


# fixed values: behaviours of compiled code: kind, category, evidence
BEHAVIOURS = (
    ("wsh_warning_suppression", "registry", (r"HKEY_CURRENT_USER\SOFTWARE\Microsoft\Windows Script Host\Settings",)),
    ("script_payload_staging", "com", ("ADODB.Stream", "ScriptControl")),
    ("wsf_payload_output", "file", (".WSF", "ScriptControl")),
    ("reactor_persistence", "persistence", ("[VLR-DWG-Reactor",)),
    ("timestamped_artifact_naming", "naming", ("M=$(edtime,$(getvar,date),MSECDDYYMOMMHHSS)", "M=$(edtime,$(getvar,date),YYMODD)")),
    ("file_search_copy_propagation", "propagation", ("findfile", "vl-file-copy")),
)
# fixed values: texts and called names that behaviours are known by
BEHAVIOUR_TEXTS = {
    "settings": r"windows script host\settings", "control": "scriptcontrol", "stream": "adodb.stream", "wsf": ".wsf", "reactor": "vlr-dwg-reactor",
    "stamp": "$(edtime,$(getvar,date)", "edtime": "edtime", "find": "findfile", "copy": "vl-file-copy",
}
BEHAVIOUR_CALLS = {"control": "scriptcontrol", "reactor": "vlr-dwg-reactor", "getvar": "getvar", "find": "findfile", "copy": "vl-file-copy"}


def behaviours(instr: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """``(sample_id, kind, category, functions, evidence)`` of what strings
    and calls of a compiled file show together.

    ``instr`` as :func:`instructions` gives it, ``strings(sample_id, value)``
    the file's string table (strings that code pushes count as well).
    Functions are the frames of the calls, or of the strings where those are
    what a behaviour is known by.
    """
    text, pushed, call = F.lower("text"), F.col("name") == "PUSH_CONST", F.col("name").isin(*CALLS)
    none = F.lit(None).cast("int")
    rows = instr.where(F.col("text").isNotNull() & (pushed | call)).select("sample_id", "frame", text.alias("t"), call.alias("call"))
    if strings is not None:
        rows = rows.unionByName(strings.where("value is not null").select("sample_id", none.alias("frame"), F.lower("value").alias("t"), F.lit(False).alias("call")))
    t, c = F.col("t"), F.col("call")
    has = {k: ~c & F.contains(t, F.lit(w)) for k, w in BEHAVIOUR_TEXTS.items()}
    calls = {k: c & (t == w) for k, w in BEHAVIOUR_CALLS.items()}
    where = lambda x: F.array_sort(F.collect_set(F.when(x, F.col("frame"))))
    per = rows.groupBy("sample_id").agg(
        *[F.bool_or(x).alias(f"s_{k}") for k, x in has.items()], *[F.bool_or(x).alias(f"c_{k}") for k, x in calls.items()],
        *[where(calls[k]).alias(f"f_{k}") for k in ("control", "reactor")], where(calls["find"] | calls["copy"]).alias("f_files"),
        where(has["settings"]).alias("f_settings"), where(has["stamp"]).alias("f_stamp"),
    )
    s, k = (lambda x: F.col(f"s_{x}")), (lambda x: F.col(f"c_{x}"))
    shown = (
        (s("settings"), "f_settings"),
        ((s("control") | k("control")) & s("stream"), "f_control"),
        ((s("control") | k("control")) & s("wsf"), "f_control"),
        (s("reactor") | k("reactor"), "f_reactor"),
        (s("stamp") | k("getvar") & s("edtime"), "f_stamp"),
        (s("find") | k("find") | s("copy") | k("copy"), "f_files"),
    )
    each = [
        F.when(seen, F.struct(F.lit(kind).alias("kind"), F.lit(category).alias("category"), F.col(fns).alias("functions"), F.array(*map(F.lit, evidence)).alias("evidence")))
        for (kind, category, evidence), (seen, fns) in zip(BEHAVIOURS, shown)
    ]
    return per.select("sample_id", F.explode(F.array_compact(F.array(*each))).alias("b")).select("sample_id", "b.*")


def recovered_functions(instr: DataFrame) -> DataFrame:
    """``(sample_id, fn)`` of the functions of compiled code."""
    return instr.where(F.col("name").isin(*FRAMES)).select("sample_id", frame_name(F.col("position")).alias("fn")).distinct()


def recovered_calls(instr: DataFrame) -> DataFrame:
    """``(sample_id, fn, name, line)`` of the calls of compiled code."""
    rows = instr.where(F.col("name").isin(*CALLS) & F.col("frame").isNotNull() & F.col("text").isNotNull())
    return rows.select("sample_id", frame_name(F.col("frame")).alias("fn"), F.lower("text").alias("name"), F.lit(None).cast("int").alias("line"))


def recovered_aliases(instr: DataFrame) -> DataFrame:
    """``(sample_id, fn, name, target)``: names that code binds functions to,
    taken from a definition's symbol and the function pushed before it."""
    w = Window.partitionBy("sample_id").orderBy("seq")
    made = F.when(F.lag("name", 1).over(w) == "FUNC", F.lag("position", 1).over(w))
    rows = instr.withColumn("made", made).where((F.col("name") == "SETQ_DEFUN") & F.col("text").isNotNull() & F.col("made").isNotNull())
    return rows.select("sample_id", F.lit("__toplevel__").alias("fn"), F.lower("text").alias("name"), frame_name(F.col("made")).alias("target"))


def frame_name(frame: Column) -> Column:
    return F.format_string("fn_%04x", frame)
